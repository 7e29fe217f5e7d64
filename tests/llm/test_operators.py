"""The operators on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F


from tessera.llm import additive_ann, bpe, catalog, edit_counts, exact_dedup, language_id, mixing, simhash, sparse_suffixes, toxicity, warc_revisits
from tessera.llm.common import fresh, join_unique
from tessera.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, kept string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "x", "x", "x", "x") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    passage = " ".join(rng.choices(words, k=60))
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "en", None), (21, base[0] + "\n ", "de", "s0"), (21, base[0] + "\n ", "de", "s0")]
    rows += [(22, None, None, None), (23, "", "en", "s1"), (24, " \t\n", "en", "s1"), (None, base[1], "en", "s2"), (25, "x" * 30_000, "en", "s2")]
    rows += [(30, base[2] + " " + passage, "en", "s0"), (31, passage + " " + base[3], "en", "s0"), (32, base[4].replace("w1 ", "w2 "), "en", "s0")]
    return docs(spark, rows)


def test_exact_groups(spark, awkward):
    found = exact_dedup.content_groups(awkward).collect()
    assert len(found) == awkward.count()
    texts = {}
    for r in awkward.collect():
        texts.setdefault("".join((r.text or "").split()), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    for r in found:
        group = next(g for t, g in texts.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        best = min(group)
        assert (r.keep_id, r.group_size) == (None if best[1] else best[2], len(group))
    assert sum(r.kept for r in found) == len(texts)
    assert exact_dedup.without_copies(awkward).columns == awkward.columns
    assert exact_dedup.without_copies(awkward).count() == len(texts)


def test_a_hot_group_is_salted_and_whole(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    found = exact_dedup.content_groups(many)
    assert found.where("kept").count() == 2001
    assert found.where("group_size = 1000 AND keep_id = 0").count() == 1000


def test_near_duplicates_by_contract(spark, awkward):
    found = simhash.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    ids = {}
    for r in awkward.collect():
        ids[(r.doc_id, simhash.fingerprint(r.text, 4) & (1 << 64) - 1)] = None
    nodes = sorted({p for _, p in ids})
    group = {p: {p} for p in nodes}
    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    for r in found:
        members = [i for i, p in ids if p in group[int(r.fingerprint, 16)] and i is not None]
        assert r.component_id == min(members)


def test_one_of_each_keeps_clean_rows(spark, awkward):
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {2, 3, 4, 5, 6, 25, 30, 31} <= ids  # 60 of 180 words are shared, which is below 0.8
    assert not {20, 21, 23, 24} & ids or len({20, 21} & ids) == 0
    assert 32 not in ids or simhash.jaccard(*[r.text for r in awkward.where("doc_id IN (4, 32)").collect()], 5) < 0.8


def test_near_copies_are_caught(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        words = [rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(300)]
        rows.append((i, " ".join(words), "en", "s"))
        words[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(words), "en", "s"))
    ids = {r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect()}
    assert ids == set(range(60))


def test_copies_of_one_base_are_all_caught(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base), "en", "s")]
    while len(rows) <= 320:
        words = list(base)
        for at in rng.sample(range(300), rng.randint(4, 6)):
            words[at] = f"x{rng.randrange(10**9)}"
        if 0.82 <= simhash.jaccard(rows[0][1], " ".join(words), 5) <= 0.88:
            rows.append((len(rows), " ".join(words), "en", "s"))
    assert simhash.jaccard(rows[1][1], rows[2][1], 5) < 0.8
    assert [r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect()] == [0]


def test_pairs_of_a_large_group_are_in_proportion_to_its_rows(spark, monkeypatch):
    rng = random.Random(13)
    rows = []
    for base in ([f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(3)):
        for _ in range(200):
            words = list(base)
            for at in rng.sample(range(120), rng.randint(0, 6)):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words), "en", "s"))
    sets = [set(np.frombuffer(simhash.shingle_digests(r[1], 5), np.uint64).tolist()) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    made, whole = spark.sparkContext.accumulator(0), simhash._wide_compare

    def counted(radius):
        def run(batches):
            for b in whole(radius)(batches):
                made.add(b.num_rows)
                yield b

        return run

    monkeypatch.setattr(simhash, "_wide_compare", counted)
    monkeypatch.setattr(simhash, "WIDE_TILE", 16)
    assert {r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect()} == set(label)
    assert 0 < made.value < 16 * len(rows)


def test_components_are_those_of_all_links_in_few_tasks(spark):
    rng = random.Random(17)
    key = lambda i: (None if i == 0 else i // 2, i % 2)  # noqa: E731  ids may be null, and repeat
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(395, 520)] + [(5, 5), (7, 8), (8, 7)]
    label = {i: i for p in pairs for i in p if p[0] != p[1]}
    for a, b in pairs:
        if a != b and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    kind = "struct<i:bigint,h:bigint>"
    edges = spark.createDataFrame([(key(a), key(b)) for a, b in pairs], f"a {kind}, b {kind}")
    spark.sparkContext.setJobGroup("components", "components")
    found = [(tuple(r.node), tuple(r.root)) for r in components(edges).collect()]
    jobs, tracker = spark.sparkContext.statusTracker().getJobIdsForGroup("components"), spark.sparkContext.statusTracker()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(str, found)) == sorted(str((key(i), key(x))) for i, x in label.items())
    tasks = sum(tracker.getStageInfo(k).numCompletedTasks for k in {k for j in jobs for k in tracker.getJobInfo(j).stageIds} if tracker.getStageInfo(k))
    assert 0 < tasks < 75


def test_parts_meet_as_all_pairs_say():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 14, rng.integers(0, 12))).astype(np.uint64) for _ in range(25)]
        part = rng.integers(0, 20, 25)
        rest = np.flatnonzero(part != 0)
        similar = lambda a, b: len(np.union1d(a, b)) == 0 or len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.6

        def merged(pairs):
            label = part.copy()
            for i, j in pairs:
                label[label == label[i]] = label[j]
            return {(i, j) for i in range(25) for j in range(25) if label[i] == label[j]}

        every = [(i, j) for i in range(25) for j in range(25) if i != j and similar(sets[i], sets[j])]
        found = list(zip(*simhash.parted(part, rest, sets, 0.6)))
        assert set(found) <= set(every)
        assert merged(found) == merged(every)


def test_mixing(spark, awkward):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count()
    sizes = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").split())) for r in awkward.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in rows) == sizes
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for source_size, target in {(r.source_size, r.target) for r in rows}:
        taken = sum(r.taken for r in rows if (r.source_size, r.target) == (source_size, target))
        assert abs(taken - target) <= 2 * mixing.BLOCK_WORDS
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(awkward.repartition(7)).collect()))
    copies = mixing.mixed_documents(awkward)
    assert copies.columns == awkward.columns
    assert {22, 23, 24} <= {r.doc_id for r in copies.collect()}


def test_words_taken_are_those_of_blocks_made_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(8)
    rows = [(i, " ".join("w" * (i % 3 + 1) for _ in range(rng.randrange(90))), "en", rng.choice(["a", "b", None])) for i in range(200)]
    found = mixing._mixed(docs(spark, rows), 0, mixing.cycle_weights, "doc_id", "text", "source", False).collect()
    shards = {}
    for r in found:
        shards.setdefault((r["__source_no"], r["__shard"]), []).append(r)
    assert len(shards) > 12
    for part in shards.values():
        part.sort(key=lambda r: (r["__order"], r["__id"]))
        n, quota, phase = part[0]["__blocks"], part[0]["__quota"], part[0]["__phase"]
        assert n == max(1, -(-sum(r["__size"] for r in part) // mixing.BLOCK_WORDS))
        times = [quota // n + ((k + 1) * (quota % n) + phase) // n - (k * (quota % n) + phase) // n for k in range(n)]
        assert sum(times) == quota and max(times) - min(times) <= 1
        word = 0
        for r in part:
            assert r["__taken"] == sum(times[w // mixing.BLOCK_WORDS] for w in range(word, word + r["__size"]))
            word += r["__size"]
    for source in {r["__source_no"] for r in found}:
        quotas = {r["__shard"]: r["__quota"] for r in found if r["__source_no"] == source}
        assert sum(quotas.values()) == next(r["__seats"] for r in found if r["__source_no"] == source)


def test_hot_keys_are_salted_and_whole(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    found = join_unique(left, right, "k")
    assert sorted((r.id, r.k, r.v) for r in found.collect()) == sorted((i, k, 3 * k) for i, k in left.collect())
    assert fresh(right, "V") == "V_"


def test_token_digests(spark, awkward):
    plain = _plain()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    for r in bpe.token_digests(awkward).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    whole = bpe.with_tokens(awkward).collect()
    assert all(r.decoded.decode() == texts[r.doc_id] for r in whole)


def test_edit_counts(spark, awkward):
    with_edits = awkward.withColumn("edits", edit_counts.edit_script(F.col("text"))).withColumn("segments", F.lit("x"))
    plain = _plain()
    want = {}
    for r in with_edits.collect():
        text = r.text or ""
        for e in r.edits:
            at = min(e.start, len(text))
            text = text[:at] + e.replacement + text[at + e.length :]
        want[r.doc_id] = (len(plain.encode_ordinary(text)), text)
    trees = edit_counts.with_segments(with_edits)
    edited = edit_counts.apply_edits(trees)
    for r in edited.collect():
        assert (r.n_tokens_after, r.text) == want[r.doc_id]
        assert sum(s.chars for s in r.segments) == len(r.text) and sum(s.tokens for s in r.segments) == r.n_tokens_after
        assert r.reencoded_chars <= 3 * 4 * edit_counts.SEGMENT or r.doc_id == 25
    again = edit_counts.apply_edits(edited.withColumn("edits", F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("replacement")))))
    assert {(r.doc_id, r.n_tokens_before, r.n_tokens_after) for r in again.collect()} == {(i, n, n) for i, (n, _) in want.items()}
    none = edit_counts.apply_edits(awkward.withColumn("edits", F.lit(None).cast("array<struct<start:int,length:int,replacement:string>>")).withColumn("segments", F.lit(None).cast(edit_counts.SEGMENTS)))
    assert all(r.n_tokens_before == r.n_tokens_after and r.reencoded_chars == 0 for r in none.collect())


def _plain():
    import base64

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_repeated_spans(spark, awkward):
    found = {(r.doc_id, r.start_word, r.end_word) for r in sparse_suffixes.repeated_spans(awkward).collect()}
    texts = [(r.doc_id, (r.text or "").split()) for r in awkward.where("doc_id IS NOT NULL").collect()]
    seen = {}
    for i, words in texts:
        for at in range(len(words) - 49):
            seen.setdefault(tuple(words[at : at + 50]), set()).add(i)
    want = set()
    for i, words in dict(texts).items():
        places = [at for at in range(len(words) - 49) if len(seen[tuple(words[at : at + 50])]) > 1]
        for at in places:
            start = at
            if any(s <= at <= e for d, s, e in want if d == i):
                d, start, _ = next(x for x in want if x[0] == i and x[1] <= at <= x[2])
                want = {x for x in want if not (x[0] == i and x[1] == start)}
            want.add((i, start, at + 50))
    assert found == want and any(d == 31 for d, _, _ in found)


def test_language_of_texts(spark, awkward):
    learned = {"en": ["the quick brown fox and the lazy dog " * 5], "de": ["der schnelle braune fuchs und der faule hund " * 5]}
    rows = docs(spark, [(1, "the lazy fox", None, None), (2, "der faule fuchs", None, None), (3, None, None, None), (4, "123 !!", None, None)])
    found = {r.doc_id: r.lang_pred for r in language_id.identify(rows, learned).collect()}
    assert found == {1: "en", 2: "de", 3: "und", 4: "und"}
    assert language_id.identify(awkward, {}).where("lang_pred <> 'und'").count() == 0


def test_toxicity_keeps_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    scorer = toxicity.learn_from(awkward, labels)
    rows = toxicity.with_scores(awkward, scorer, "__s").collect()
    assert len(rows) == awkward.count() and all(0 <= r["__s"] <= 1 for r in rows)


def test_search(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(300)] + [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] + [1.0] * 7, 0), (303, [None] + [1.0] * 7, 0)]
    rows += [(i, rows[0][1], 0) for i in range(400, 420)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = additive_ann.search(vectors, lambda i: i % 100 == 0).collect()
    import numpy as np

    data = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    hits = 0
    for q in (0, 100, 200, 400):
        near = sorted((float(np.sqrt(((data[q] - x) ** 2).sum())), i) for i, x in data.items() if i != q)[:10]
        got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11))
        hits += len({i for _, i in near} & {g[1] for g in got})
    assert hits >= 36
    assert {r.query_id for r in found} == {0, 100, 200, 400}


def test_each_vector_is_asked_and_found_once(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    once, twice = (sorted(map(tuple, additive_ann.search(v, lambda i: i % 100 == 0).collect())) for v in (vectors, vectors.union(vectors)))
    assert once == twice and len(once) == 20


def test_search_in_slices_with_a_short_list(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(6000, 16)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    found = additive_ann.search(vectors, lambda i: i % 100 == 0, slice_rows=2000).collect()  # 80 of 1500 or so are ranked exactly
    wide, hits = data.astype(np.float64), 0
    for q in range(0, 6000, 100):
        far = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        got = {r.vec_id: r.score for r in found if r.query_id == q}
        assert len(got) == 10 and all(abs(far[i] - s) < 1e-12 for i, s in got.items())
        hits += len(got.keys() & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits >= 540


def test_revisits(spark):
    h = {"Content-Length": "9", "date": "a"}
    rows = [
        ("r1", "http://www.Example.com/a/", 10, "response", '"1"', None, h), ("r2", "https://example.com/a", 20, "response", '"2"', None, h),
        ("v1", "http://example.com/a#x", 15, "revisit", 'W/"1"', None, {"Date": "b", "content-length": "0", "DATE": "b"}), ("v2", "http://example.com/a", 20, "revisit", '"1"', None, {}),
        ("v3", "http://example.com/a", 99_999, "revisit", '"1"', None, {}), ("v4", "http://example.com/b", 50, "revisit", '"1"', None, None), ("v5", None, 5, "revisit", None, None, None),
        ("v6", "http://example.com/a", 30, "revisit", None, "x", {}), (None, "http://example.com/a", None, "response", None, None, None),
    ]
    captures = spark.createDataFrame(rows, "record_id string, uri string, at long, type string, etag string, last_modified string, headers map<string,string>")
    found = {r.record_id: r for r in warc_revisits.resolve(captures).collect()}
    assert {k: (r.response_id, r.status) for k, r in found.items()} == {
        "v1": ("r1", "resolved"), "v2": ("r1", "resolved"), "v3": ("r2", "changed"), "v4": (None, "no_response"), "v5": (None, "no_response"), "v6": ("r2", "no_validator"),
    }
    assert found["v1"].headers == {"content-length": "9", "date": "b"}
    assert warc_revisits.resolve(captures.limit(0)).count() == 0
    twice = warc_revisits.resolve(captures.union(captures).withColumn("url", F.lit("x"))).collect()
    assert len(twice) == 2 * len(found)


def test_a_busy_url_is_cut_into_shorter_spans(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "http://a.com/x" if i % 3 else f"http://a.com/{i}", rng.randrange(4000), "revisit" if i % 2 else "response", None, None, None) for i in range(600)]
    captures = spark.createDataFrame(rows, "record_id long, uri string, at long, type string, etag string, last_modified string, headers map<string,string>")
    want = sorted((r.record_id, r.response_id) for r in warc_revisits.resolve(captures).collect())
    monkeypatch.setattr(warc_revisits, "LEAST_BUSY", 5)
    assert sorted((r.record_id, r.response_id) for r in warc_revisits.resolve(captures).collect()) == want
    for i, found in want:
        _, uri, at, *_ = rows[i]
        before = [(t, k) for k, u, t, kind, *_ in rows if u == uri and kind == "response" and t < at]
        assert found == (max(before)[1] if before else None)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.content_groups(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert bpe.token_digests(none).count() == 0
    assert edit_counts.apply_edits(edit_counts.with_segments(none.withColumn("edits", edit_counts.edit_script(F.col("text"))))).count() == 0
    assert sparse_suffixes.repeated_spans(none).count() == 0
    assert language_id.identify(none, language_id.samples(none)).count() == 0
    assert toxicity.with_scores(none, toxicity.learn_from(none, spark.createDataFrame([], "doc_id long, toxic int")), "__s").count() == 0
    assert additive_ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).count() == 0
    assert isinstance(Row(a=1), Row) and len(catalog.QUERIES) == 10
