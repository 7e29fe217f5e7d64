"""The pipeline and the queries end to end, on tables with awkward rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import catalog, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, __key string, __score string, lo string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "ll", "")]
    rows, toxic = [], {}
    for i in range(240):
        text = " ".join(rng.choices(words, k=rng.randrange(80, 160)))
        toxic[i] = int(i % 6 == 0)
        if toxic[i]:
            text += " you stupid idiot you complete idiot"
        rows.append((i, text, ("en", "de")[i % 2], f"s{i % 3}"))
    clean = [r for r in rows if not toxic[r[0]]]
    rows += [(300, clean[0][1].replace(" ", "  "), "en", None), (301, clean[0][1], "en", "s1"), (302, None, None, None), (303, "", "en", "s1"), (304, " \n", "en", "s2")]
    near = clean[1][1].split()
    near[3] = "changed"
    rows += [(310, " ".join(near), "en", "s0"), (311, clean[2][1].upper(), "de", "s2"), (320, "long " + " ".join(rng.choices(words, k=60_000)), "en", "s0"), (320, "x" * 50_000, "en", "s0")]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "s", "k", "t", "l") for r in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(150)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(i, f"http://example.com/{i % 9}", f"<p>{i}</p>") for i in range(60)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path), rows, toxic


def test_the_pipeline_keeps_what_is_clean(spark, folder):
    path, rows, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).persist()
        assert docs.columns == spark.read.parquet(f"{path}/documents.parquet").columns, name
        assert docs.where("score <> 's' OR __key <> 'k' OR __score <> 't' OR lo <> 'l'").count() == 0
        kept[name] = [r.doc_id for r in docs.collect()]
    bad = {i for i, t in toxic.items() if t}
    assert not bad & set(kept["toxicity"]) and set(kept["toxicity"]) == {r[0] for r in rows} - bad
    exact = set(kept["exact_dedup"])
    assert not {301} & exact and 300 in exact and len({302, 303, 304} & exact) == 1  # the longest original stays
    near = set(kept["near_dedup"])
    assert near == exact - {310, 311}
    assert set(kept["mixing"]) <= near
    found = corpus_pipeline.run(spark, path)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r.doc_id for r in found.collect()) == sorted(kept["mixing"])


def test_each_stage_reads_what_was_written_once(spark, folder, monkeypatch):
    path, _, _ = folder
    seen = spark.sparkContext.accumulator(0)

    def counting(spark_, docs, sf_dir):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return docs.mapInArrow(run, docs.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("count", counting), *corpus_pipeline.STAGES[1:]])
    corpus_pipeline.run(spark, path).count()
    assert seen.value == spark.read.parquet(f"{path}/documents.parquet").count()


def test_an_empty_corpus(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_at_the_threshold_are_found(spark):
    """Recall over pairs with a similarity from 0.8 up, of many lengths, against the similarity of each pair."""
    rng = random.Random(21)
    rows, pairs = [], 0
    for i in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 40, 120, 400]))]
        copy = list(base)
        for at in rng.sample(range(len(base)), max(1, len(base) // 60)):
            copy[at] = f"x{rng.randrange(10**6)}"
        if simhash.jaccard(" ".join(base), " ".join(copy), 5) >= 0.8:
            pairs += 1
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(0, 600, 2)) <= kept
    assert pairs > 100 and len(kept) - 300 - (300 - pairs) <= pairs // 50


def test_queries_return_one_row_a_document(spark, folder):
    path, rows, toxic = folder
    every = sorted(r[0] for r in rows)
    found = {name: query(spark, path) for name, query in catalog.QUERIES.items()}
    for name in ("op1_mix_sources", "op3_language_id", "op4_edit_counts", "op5_simhash_dedup", "op6_toxicity", "op7_bpe_codec", "op9_exact_dedup"):
        assert sorted(r.doc_id for r in found[name].select("doc_id").collect()) == every, name
    for r in found["op6_toxicity"].collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == toxic.get(r.doc_id, 0)
    languages = found["op3_language_id"].collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in languages)
    assert {r.lang_pred for r in languages if r.doc_id in (302, 303, 304)} == {"und"}
    assert found["op8_additive_ann"].count() == 20
    assert found["op2_warc_revisits"].count() == 60
