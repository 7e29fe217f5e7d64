"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import evaluation, work
from tessera.functions import values as V
from tessera.sources import commits, readers, writers
from tessera.streaming import progress

DOCUMENT = T.StructType([T.StructField("n", T.IntegerType())])


def test_documents_of_two_folders(spark, tmp_path):
    for folder, name, n in (("a", "c1", 1), ("b", "c1", 2), ("b", "c2", 3)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.json").write_text(json.dumps({"n": n}))
    found = readers.case_documents(spark, str(tmp_path / "a"), str(tmp_path / "b"), DOCUMENT)
    assert sorted((r.case_id, r.n) for r in found.collect()) == [("c1", 1), ("c2", 3)]
    assert readers.case_documents(spark, str(tmp_path / "x"), str(tmp_path / "y"), DOCUMENT).count() == 0
    (tmp_path / "a" / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="no JSON object"):
        readers.documents(spark, str(tmp_path / "a" / "*.json"), DOCUMENT).collect()


def test_paths_are_followed_without_reading_by_row(spark, tmp_path):
    (tmp_path / "run").mkdir()
    for name, n in (("run/d1.json", 1), ("d2.json", 2)):
        (tmp_path / name).write_text(json.dumps({"n": n}))
    cases = readers.documents(spark, str(tmp_path / "*.json"), DOCUMENT).unionByName(readers.documents(spark, str(tmp_path / "run" / "*.json"), DOCUMENT))
    rows = spark.createDataFrame([(1, "d1.json"), (2, "d2.json"), (3, f"{tmp_path}/d2.json"), (4, "none.json"), (5, None)], "i int, document_path string")
    found = readers.followed(rows, "document_path", cases, [str(tmp_path / "run"), str(tmp_path)])
    assert {r.i: r.document.n if r.document else None for r in found.collect()} == {1: 1, 2: 2, 3: 2, 4: None, 5: None}


def test_missing_extracts_are_empty(spark, tmp_path):
    assert readers.extract(spark, str(tmp_path / "none.csv"), DOCUMENT).count() == 0
    (tmp_path / "x.csv").write_text("n\n1\n2\n")
    assert readers.extract(spark, str(tmp_path / "x.csv"), DOCUMENT, 1).count() == 1


def test_bad_lines_know_their_place(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"case_id": "a"}\nnot\n\n{"case_id": "b"}\nbad\n')
    _, bad = readers.tolerant_manifest(spark, str(tmp_path / "m.jsonl"))
    assert [r.line for r in bad.orderBy("file", "place").collect()] == ["not", "bad"]


def test_documents_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "summary.json")
    for value in ({"ä": 1}, {"b": [1, None]}):
        commits.write_document(spark, path, value)
        text = (tmp_path / "summary.json").read_text()
        assert json.loads(text) == value and text.endswith("}\n")
    assert "ä" not in text and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["summary.json"]


def test_all_tables_or_none(spark, tmp_path):
    one, two = (spark.createDataFrame([(i,)], "n int") for i in (1, 2))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    commits.commit_all({a: one, b: one})
    commits.commit_all({a: two, b: two})
    assert [spark.read.parquet(p).first().n for p in (a, b)] == [2, 2]
    bad = two.select(F.raise_error(F.lit("stop")).cast("int").alias("n"))
    with pytest.raises(Exception, match="stop"):
        commits.commit_all({a: one, b: bad})
    assert [spark.read.parquet(p).first().n for p in (a, b)] == [2, 2]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    commits.replace_table(one, a)
    assert spark.read.parquet(a).first().n == 1


def test_runs_are_a_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for run, status in (("r1", "queued"), ("r2", "queued"), ("r1", "running")):
        commits.record_run(spark, path, run, status, {"k": status})
    assert [r.event for r in spark.read.parquet(path).select(F.col("event")).limit(1).collect()][0]
    found = {r.run_id: r for r in commits.current_runs(spark.read.parquet(path)).collect()}
    assert found["r2"].status == "queued" and found["r1"].created_at <= found["r1"].updated_at
    assert found["r1"].status in ("queued", "running") and json.loads(found["r1"].fields)["k"] == found["r1"].status


def test_contracts_are_exported(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("xs", T.ArrayType(T.LongType())), T.StructField("m", T.MapType(T.StringType(), T.DoubleType()))])
    commits.export_schemas(spark, {"finding": schema}, str(tmp_path))
    found = json.loads((tmp_path / "finding.json").read_text())
    assert found["required"] == ["id"] and found["properties"]["xs"] == {"type": "array", "items": {"type": "integer"}}
    assert found["properties"]["m"]["additionalProperties"] == {"type": "number"}


def test_csv_without_columns(spark, tmp_path):
    writers.csv(spark.createDataFrame([], T.StructType([])), str(tmp_path / "x"))
    assert "empty" in spark.read.option("header", True).csv(str(tmp_path / "x")).columns or spark.read.text(str(tmp_path / "x")).count() <= 1


def test_limits_are_whole_numbers(spark):
    rows = spark.range(5)
    assert [r.id for r in work.limited(rows, 2, ["id"]).collect()] == [0, 1] and work.limited(rows, None, ["id"]).count() == 5
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            work.limited(rows, bad, ["id"])


def test_evidence_is_kept_to_its_budget(spark):
    text = "One. " + "x" * 700 + ". \n. " + "Two! three"
    rows = spark.createDataFrame([(text,), (None,), ("  ",)], "t string")
    found = [[(s.start, s.length) for s in r.s] for r in rows.select(evaluation.evidence_budget(F.col("t"), 620, 600).alias("s")).collect()]
    assert found == [[(0, 4), (4, 600), (706, 3), (709, 5), (714, 6)], [], []]
    short = rows.limit(1).select(evaluation.evidence_budget(F.col("t"), 10, 8).alias("s")).first().s
    assert [(s.start, s.length) for s in short] == [(0, 4), (4, 6)]


def test_answers_with_prose_and_fences(spark):
    cases = {'{"a": 1}': '{"a":1}', '```json\n{"a": 1}\n```': '{"a":1}', 'so: {"a": {"b": 2}} done': '{"a":{"b":2}}', "[1]": None, "{x": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r.o for r in rows.select(V.json_object(F.col("t")).alias("o")).collect()] == list(cases.values())
    masked = rows.limit(1).select(V.without_secrets(F.lit('{"api_key": "x", "a": [{"Password": 1, "b": 2}]}')).alias("m")).first().m
    assert json.loads(masked) == {"api_key": "***", "a": [{"Password": "***", "b": 2}]}


def _events(spark, rows):
    return spark.createDataFrame([(i, f"2024-01-01 00:{t}", r, s) for i, t, r, s in rows], "event_id long, ts string, run_id long, status string").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return stream.sparkSession.table(name).collect()


def test_windows_of_a_stream(spark, tmp_path):
    events = _events(spark, [(1, "00:01", 1, "queued"), (2, "00:04", 1, "running"), (3, "00:30", 1, "succeeded"), (4, "00:31", 2, "queued")])
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    slid = _run(progress.tumbling(stream, "10 seconds", "5 seconds"), "slid", "complete")
    assert sorted(map(str, slid)) == sorted(map(str, progress.tumbling(events, "10 seconds", "5 seconds").collect()))
    told = _run(progress.sessions(stream, "10 seconds"), "told", "complete")
    assert sorted((r.run_id, r.n) for r in told) == [(1, 1), (1, 2), (2, 1)]


def test_run_states_of_a_stream(spark, tmp_path):
    first = [(1, "00:01", 1, "queued"), (2, "00:02", 1, "running"), (3, "00:03", 2, "running"), (4, "00:04", 2, "queued")]
    later = [(5, "00:05", 1, "succeeded"), (6, "00:06", 1, "failed"), (7, "00:01", 2, "running")]
    folder = str(tmp_path / "e")
    (tmp_path / "e").mkdir()
    stream = spark.readStream.schema(_events(spark, first).schema).parquet(folder).withWatermark("ts", "1 hour")
    states = progress.run_states(stream)
    found = {}
    for part in (first, later):
        _events(spark, part).coalesce(1).write.mode("append").parquet(folder)
        query = states.writeStream.foreachBatch(lambda df, _: found.update({r.run_id: (r.status, r.illegal) for r in df.collect()})).outputMode("update")
        query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    assert found == {1: ("succeeded", 1), 2: ("queued", 2)}


def test_statements_name_views(spark):
    from tessera.plans.sql import names_in, sql

    assert names_in("SELECT a FROM cases -- reports\nWHERE b = 'hazards'") == ["select", "a", "from", "cases", "where", "b"]
    found = sql(spark, "/root/testdata/sf0.001", "SELECT c.modality, count(*) AS n FROM cases c JOIN case_hazard_metrics h USING (case_id) GROUP BY c.modality")
    assert sum(r.n for r in found.collect()) > 0


def test_progress_is_told(spark, tmp_path):
    from tessera.streaming.listening import ProgressListener, observed

    told = []
    listener = ProgressListener(lambda name, kind, rows: told.append((name, kind)))
    spark.streams.addListener(listener)
    try:
        events = _events(spark, [(1, "00:01", 1, "queued")])
        events.write.parquet(str(tmp_path / "e"))
        _run(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "told_rows", "append")
        import time

        for _ in range(50):
            if ("told_rows", "succeeded") in told:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert ("told_rows", "started") in told and ("told_rows", "succeeded") in told
    rows, seen = observed(spark.range(7), "seven", n=F.count(F.lit(1)))
    assert rows.collect() and seen.get["n"] == 7
