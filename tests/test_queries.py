"""Every query of the library against its SQL, and the operators on literal rows."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import quality as Q
from tessera.functions import text as T
from tessera.functions.numbers import half_up
from tessera.operators import coverage, matching, ranking, state, statistics
from tessera.operators.eligibility import evidence_tier, for_hazards, for_ranking, for_statistics
from tessera.plans.queries import ORACLE_SQL, QUERIES
from tessera.sources import readers, writers
from tessera.streaming import progress

SF = "/root/testdata/sf0.001"
#: Queries that cross with a table of a few rows by definition: candidates, models, and totals of one row.
LOOPS = {"preflight", "cohen_kappa_labels", "weighted_kappa_levels", "benchmark_selection_blockers"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "orders lineitem part supplier customer events documents labels conversations pages nation".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "-"
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(map(value, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and ("BroadcastNestedLoopJoin" not in plan or name in LOOPS)
    rows = found.toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(want.columns) == sorted(rows.columns)
        assert plain(rows) == plain(want)


def test_pairs_are_compared_whole(spark, tmp_path):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [("the same words " * 20 + "left lung", "the same words " * 20 + "right lung clear."), ("Épaississement pleural à droite", "Epaississement pleural a droite."), ("short", "shirt")]
    turns = [(i, t, r, x) for i, p in enumerate(pairs) for t, r, x in ((1, "user", p[0]), (2, "assistant", p[1]))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    d = str(tmp_path)
    want = {}
    for i, p in enumerate(pairs):
        a, b = ("".join(x.split()) for x in p)
        want[i] = edits(a, b) / len(a)
    assert {r.conv_id: r.cer for r in QUERIES["ocr_cer_by_pair"](spark, d).collect()} == {i: pytest.approx(x, abs=1e-6) for i, x in want.items()}
    found = {r.model: r for r in QUERIES["ocr_model_summary"](spark, d).collect()}
    assert {m: (r.n, r.truncated) for m, r in found.items()} == {"m0": (1, 0), "m1": (1, 0), "m2": (1, 1)}
    shared = {r.conv_id: (r.ref_tokens, r.shared) for r in QUERIES["token_overlap"](spark, d).collect()}
    assert shared[0] == (5, 4) and shared[2] == (1, 0)


def test_plans_are_held_against_their_results(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    done = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "a", 2), (2, "a", 1), (2, "b", 1), (3, "a", 1)], "case_id int, candidate string, repeat int")
    found = sorted(map(tuple, coverage.plan_problems(cases, ["a"], 2, done).collect()))
    assert found == [(1, "a", 1, "duplicate"), (2, "a", 2, "missing"), (2, "b", 1, "extra"), (3, "a", 1, "extra")]


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


def test_tiers_and_the_three_exclusions(spark):
    for source, tier in (("artifact", "artifact"), (" MOCK ", "mock"), ("cloud_fallback", "debug_fallback"), ("fresh_cli", "exploratory_fresh")):
        assert one(spark, evidence_tier(F.col("s")), s=source) == tier
    judge = dict(t="exploratory_fresh", s="mock_judge")
    assert not one(spark, for_statistics(F.col("t"), F.col("s")), **judge)
    assert one(spark, for_hazards(F.col("t"), F.col("s")), **judge)
    fresh = dict(t="exploratory_fresh", s="fresh_cli")
    assert one(spark, for_ranking(F.col("t"), F.col("s"), F.lit(True)), **fresh)
    assert not one(spark, for_statistics(F.col("t"), F.col("s"), F.lit(True)), **fresh)


def test_midranks(spark):
    rows = statistics.midrank_percentile(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (float("nan"),)], "value double"))
    assert sorted(r.percentile for r in rows.collect()) == [0.0, 12.5, 50.0, 50.0, 87.5]


def test_judge_pairs_are_counted_without_being_made(spark, tmp_path):
    keys = [*range(1, 700), *range(4000, 4200), 5, 5, 9000, None]
    rows = [(k, None if i % 40 == 0 else i % 3) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    found = QUERIES["judge_pairs"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and " < " in x]
    want = {}
    for a, n in rows:
        for b, m in rows:
            if None not in (a, b, n, m) and n == m and a < b:
                same = a % 3 == 0 and b % 2 == 0
                want[same] = want.get(same, 0) + 1
    assert {r.same: r.n for r in found.collect()} == want


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "name string, p double")
    found = {r.name: round(r.p_holm, 6) for r in statistics.holm(rows, "p", []).collect()}
    assert found == {"a": 0.04, "b": 0.09, "c": 0.09, "d": 1.0}


def test_kappa_without_variation(spark):
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert statistics.cohen_kappa(same, "a", "b").first().kappa == 1.0


def test_best_assignment_against_brute_force():
    import random
    from itertools import permutations

    rng = random.Random(0)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[float(rng.randint(-20, 100)) for _ in range(m)] for _ in range(n)]
        best = max(sum(max(0.0, w[i][j]) for i, j in zip(range(n), p) if j < m) for p in permutations(range(m + n), n))
        found = matching.best_assignment(w)
        assert sum(w[i][j] for i, j in found) == best
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)


FINDING = "case_id long, side string, observation string, location string, laterality string, certainty string, severity string, mm double, finding_id int"


def test_alignment_of_equal_and_generic_findings(spark):
    rows = [
        (1, "cand", "nodule", "upper", "left", "present", "mild", 5.0, 1), (1, "cand", "nodule", "upper", "left", "present", "mild", 5.0, 2), (1, "ref", "nodule", "upper", "left", "present", "mild", 8.0, 3),
        (2, "cand", "other finding", "upper", "left", "present", "mild", None, 4), (2, "ref", "other finding", "upper", "left", "present", "mild", None, 5), (2, "ref", "mass", "lower", "unknown", "absent", "mild", None, 6),
        (3, "cand", "mass", "lower", "right", "present", "mild", None, 7), (3, "cand", "mass", "upper", "right", "present", "mild", None, 8),
        (3, "ref", "mass", "upper", "right", "present", "mild", None, 9), (3, "ref", "mass", "lower", "left", "absent", "mild", None, 10), (4, "cand", None, "x", "left", "present", "mild", None, 11),
    ]
    findings = spark.createDataFrame(rows, FINDING)
    assert sorted((r.case_id, r.cand_id, r.ref_id) for r in matching.assignments(findings).collect()) == [(1, 1, 3), (3, 7, 10), (3, 8, 9)]
    assert sorted((r.finding_id, r.error) for r in matching.unpaired(findings).collect()) == [(2, "false_finding"), (4, "false_finding"), (5, "omission_finding"), (6, "omission_finding"), (11, "false_finding")]
    strict = {r.case_id: (r.matched, r.approximate_match, r.mismatched, r.precision, r.recall, r.f1) for r in matching.strict_metrics(findings).collect()}
    assert strict == {1: (0, 1, 0, 0.5, 1.0, 0.6667), 2: (0, 0, 0, 0.0, 0.0, 0.0), 3: (1, 0, 1, 0.5, 0.5, 0.5), 4: (0, 0, 0, 0.0, 0.0, 0.0)}


def test_assignment_has_the_most_points(spark):
    from itertools import permutations

    from tessera.plans import adapters as A

    findings = A.findings(spark, SF).withColumn("observation", F.lit("one"))
    pairs = {}
    for r in matching.pair_scores(findings).collect():
        pairs.setdefault(r.case_id, {})[str(r.cand_id), str(r.ref_id)] = r.points
    best = {}
    for r in matching.assignments(findings).collect():
        assert pairs[r.case_id][str(r.cand_id), str(r.ref_id)] == r.points
        best[r.case_id] = best.get(r.case_id, 0) + r.points
    for case, points in list(pairs.items())[::7]:
        cands, refs = (sorted({k[i] for k in points}) for i in (0, 1))
        wide = max(len(cands), len(refs))
        assert best[case] == max(sum(points.get((c, refs[j]), 0) for c, j in zip(cands, p) if j < len(refs)) for p in permutations(range(wide), len(cands)))


def test_payloads_of_metrics(spark):
    rows = spark.createDataFrame([(1, {"score": 0.5, "n_rows": 9.0}, None, 3.0), (2, None, {"recall": 0.25, "score": float("nan")}, 4.0), (3, None, None, 5.0)], "i int, metrics map<string,double>, composite_inputs map<string,double>, likert_mean double")
    assert sorted((r.i, r.metric, r.value) for r in statistics.payload_metrics(rows, ["i"]).collect()) == [(1, "score", 0.5), (2, "recall", 0.25), (3, "likert_mean", 5.0)]


def test_the_quality_gate(spark):
    gate = lambda t, m="cxr", b="chest": one(spark, Q.quality_gate(F.col("t"), F.col("m"), F.col("b")), t=t, m=m, b=b)
    assert gate("Follow-up: 建议CT复查。").passed and gate("A follow up with CT is advised.").passed
    assert not gate("The ct shows a nodule. Follow up is advised.").passed
    assert gate("Consider MRI. Lungs clear").modality_terms == []
    assert gate("建议核磁共振检查", "ct").passed
    found = gate("femur fracture on computed tomography")
    assert found.warnings == ["body_part_mismatch", "modality_mismatch"] and found.body_terms == ["femur"] and not found.passed
    assert gate("spleen normal").passed and gate("spleen normal").warnings == ["body_part_mismatch"]
    assert gate("双肺清晰", "mri", "Brain").body_terms == ["双肺"] and gate(None).passed


def test_top_k_with_near_cutoff(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.9, 0.8, 0.795, 0.7, None))], "c int, pos int, score double")
    found = {r.pos: (r.rank, r.selected, r.near_cutoff_review) for r in ranking.top_k(rows, "c", ["pos"], 2).collect()}
    assert found == {0: (1, True, False), 1: (2, True, False), 2: (3, False, True)}


def test_sections(spark):
    text = "Indication x\nFindings: clear\nIMPRESSION： none\nfindings: more"
    parts = one(spark, T.sections(F.col("t")), t=text)
    assert parts == {"findings": "clear\nmore", "impression": "none", "clinical_history": "", "other": "Indication x"}
    assert one(spark, T.sections(F.col("t")), t=" plain ")["findings"] == "plain"


def test_modalities(spark):
    for value, name in (("CTA chest", "ct"), ("primary", "primary"), ("胸片", "cxr"), ("MR + CT", "mri"), ("", "unknown"), (None, "unknown")):
        assert one(spark, T.modality(F.col("t")), t=value) == name


def test_personal_data(spark):
    text = "call 13812345678 or a@b.org on 2024-01-02"
    assert one(spark, T.personal_data(F.col("t")), t=text) == ["phone_number", "email_address", "calendar_date"]
    assert one(spark, T.redacted(F.col("t")), t=text) == "call [phone_number] or [email_address] on [calendar_date]"


def test_personal_data_of_reports(spark):
    text = "姓名：张三， 检查号: A-1 saved in /data/ct/case_1.dcm mark patient_canary_7-X"
    assert one(spark, T.personal_data(F.col("t")), t=text) == ["chinese_clinical_identifier", "server_absolute_path", "privacy_canary"]
    assert one(spark, T.redacted(F.col("t")), t=text) == "[chinese_clinical_identifier]， [chinese_clinical_identifier] saved in [server_absolute_path] mark [privacy_canary]"
    report = "姓名: 张三\nIndication: cough\n** Findings: clear on 2024-01-02  \n \nImpression: none\n报告医生: 李四\nprinted"
    assert one(spark, T.deidentified(F.col("t")), t=report) == "** Findings: clear on [calendar_date]\nImpression: none"
    assert one(spark, T.deidentified(F.col("t")), t=" no heading\n\nmore ") == "no heading\nmore"


def test_error_rate_of_clinical_sections(spark):
    gold, cand = "Name x\nFindings: size １２ mm\nHistory: old", "Findings: size 12 mm"
    assert one(spark, T.clinical_error_rate(F.col("g"), F.col("c")), g=gold, c=cand) == 0.0
    assert one(spark, T.clinical_error_rate(F.col("g"), F.col("c")), g="Ａb", c="Ac") == 0.5


def test_chinese_tokens_sections_and_p(spark):
    assert sorted(one(spark, T.tokens(F.col("t")), t="CT 右上肺结 Lung_1 no")) == sorted(["右上肺", "上肺结", "右上肺结", "lung_1"])
    assert one(spark, T.section_order(F.col("t")), t="Impression: a\nFindings: b\nimpression: c") == ["impression", "findings"]
    deltas = one(spark, T.section_deltas(T.sections(F.col("a")), T.sections(F.col("b"))), a="Findings: one two", b="Findings: one\nImpression: no")
    assert deltas["findings"].asDict() == dict(chars_a=7, chars_b=3, chars_delta=-4, words_a=2, words_b=1, words_delta=-1)
    assert deltas["impression"].words_delta == 1
    rows = spark.createDataFrame([(1, 4, 1.96, 2.0, 4, 0.0, 2.0), (2, 4, 1.0, 0.0, 4, 0.0, 0.0), (3, 1, 1.0, None, 4, 0.0, 0.0), (4, 4, 1.0, 0.0, 4, 1.0, 0.0)], "i int, n_a int, mean_a double, var_a double, n_b int, mean_b double, var_b double")
    found = {r.i: r.p for r in rows.select("i", statistics.welch_p(*map(F.col, rows.columns[1:])).alias("p")).collect()}
    assert found == {1: pytest.approx(0.0499958, abs=1e-6), 2: 0.0, 3: 1.0, 4: 1.0}


def test_state_machine_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", i % 2, s) for i, s in enumerate(["queued", "queued", "running", "succeeded", "failed", "running", "queued"])]
    events = spark.createDataFrame(rows, "event_id long, ts string, run_id long, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    steps = state.transitions(events, "run_id", ["ts", "event_id"], "status")
    assert [r.legal for r in steps.where("run_id = 0").orderBy("event_id").collect()] == [True] * 4
    assert [r.legal for r in steps.where("run_id = 1").orderBy("event_id").collect()] == [True, False, False]
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    done = progress.tumbling(stream, "10 seconds").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, progress.tumbling(events, "10 seconds").collect()))


def test_tolerant_manifest(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"id": "c1", "radiologist_id": "r"}\n\nnot json\n{"case_id": "c2", "modality": ""}\n')
    good, bad = readers.tolerant_manifest(spark, str(path))
    assert sorted((r.case_id, r.reader, r.modality) for r in good.collect()) == [("c1", "r", "unknown"), ("c2", "unknown", "unknown")]
    assert [r.line for r in bad.collect()] == ["not json"]


def test_registry_masks_secrets(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"api_key": "x", "seed": "1"})], "run_id int, config map<string,string>")
    writers.append_registry(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().config == {"api_key": "***", "seed": "1"}


def test_rounding(spark):
    assert spark.range(1).select(half_up(F.lit(1.23456789), 4)).first()[0] == 1.2346
