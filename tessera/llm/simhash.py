"""SimHash near-dedup by tiled exact comparison (operator 5).

Fingerprints are made in one pass over the texts. Distinct fingerprints are then compared exactly: a pair within the radius
agrees on at least ``blocks - radius`` of ``blocks`` bit blocks, so each combination of that many blocks is a table of
buckets, and every linked pair meets in a bucket of some table. A bucket is one tile, or, when it is large, a grid of tiles by
bands of population counts and a salt; pairs of tiles whose counts differ beyond the radius are never made. Inside a tile
pair, numpy exclusive-or and bit counts compare all rows against those whose counts are within the radius. A tile pair
returns a spanning forest of its links, which holds the same components as all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tessera.llm.common import checkpointed, fresh, join_unique, partitions, per_batch, table
from tessera.llm.components import components

BITS = 64
#: Rows of a tile, and the mean bucket that a set of tables may have.
TILE, WIDE_TILE, MEAN_BUCKET = 4096, 2048, 2048
#: For wide fingerprints: bits drawn for a table at least, and the chance that a pair at the threshold meets in no table.
SAMPLED, MISSED = 16, 0.002
#: Tables of wide fingerprints that are met first, so that the others need not return again what these have connected.
FIRST = 8
#: Pairs a row up to which a group of close fingerprints is sparse, and the shingles of one side of a tile of a dense group.
SPARSE, SIDE = 2, 250_000


def shingle_digests(text: str | None, width: int, seed: int = 42) -> bytes:
    """The XXH64 digests of a text's shingles of ``width`` words, one after the other; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_digest(joined, seed)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[width:]]
    ends.append(len(joined))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends)])


def fingerprint(text: str | None, width: int) -> int:
    """The text's SimHash over shingles of ``width`` words, as a signed 64-bit integer; 0 without a word."""
    hashes = np.frombuffer(shingle_digests(text, width), np.uint8).reshape(-1, 8)
    return _bits(hashes)


def _bits(hashes: np.ndarray) -> int:
    """One bit for each column of ``hashes`` (rows of 8 bytes) that is set in over half the rows."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, width: int = 4, text_col: str = "text", out: str = "fp") -> DataFrame:
    """All columns of ``docs`` and a long column ``out``. Null and blank texts get 0. A column that is named ``out`` already is replaced."""
    docs = docs.drop(out)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = pa.array([fingerprint(x, width) for x in batch.column(at).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, out])

    return docs.mapInArrow(per_batch(run), StructType([*docs.schema.fields]).add(out, LongType()))


def tables_for(count: int, radius: int) -> tuple[int, int]:
    """The number of bit blocks, and how many of them form a key, so that a mean bucket holds MEAN_BUCKET rows or fewer."""
    for chosen in range(1, 9):
        blocks = radius + chosen
        if count / 2 ** (BITS * chosen / blocks) <= MEAN_BUCKET:
            break
    return blocks, chosen


def _masks(blocks: int, chosen: int) -> list[int]:
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(parts, chosen)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _links(ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints ``ids`` (uint64, distinct)."""
    counts = np.bitwise_count(ids)
    order = np.argsort(counts, kind="stable")
    ids, counts = ids[order], counts[order].astype(np.int64)
    signed = ids.view(np.int64)
    label = np.arange(len(ids))
    highs = np.searchsorted(counts, counts + radius, side="right")
    out = []
    step = 256
    for low in range(0, len(ids), step):
        high = int(highs[min(low + step, len(ids)) - 1])
        near = np.bitwise_count(ids[low : low + step, None] ^ ids[None, low:high]) <= radius
        near = np.triu(near, 1)
        for i in np.flatnonzero(near.any(axis=1)):
            own, others = label[low + i], low + np.flatnonzero(near[i])
            others = others[label[others] != own]
            roots, first = np.unique(label[others], return_index=True)
            if len(roots):
                out += [(int(signed[low + i]), int(signed[j])) for j in others[first]]
                label[np.isin(label, roots)] = own
    return out


def _compare(radius: int):
    """An Arrow map over rows sorted by ``tile``: the forest of each tile pair. Holds one tile pair at a time."""

    def forest(parts: list[np.ndarray]) -> list[tuple[int, int]]:
        ids = np.unique(np.concatenate(parts).view(np.uint64))
        return _links(ids, radius) if len(ids) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            tiles = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(tiles):
                continue
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
            pairs = []
            for a, b in zip(cuts, cuts[1:]):
                if tiles[a] != tile:
                    if held:
                        pairs += forest(held)
                    tile, held = tiles[a], []
                held.append(prints[a:b].copy())
            if pairs:
                yield _edge_batch(pairs)
        if held and (pairs := forest(held)):
            yield _edge_batch(pairs)

    return run


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def links(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """A forest (columns a and b) with the components of all links between the distinct fingerprints in column ``fp``.

    Two fingerprints link when at most ``radius`` bits differ. Exact at every size: tables, tiles and bands only order the
    comparisons. No fingerprints: no rows.
    """
    spark = prints.sparkSession
    count = prints.count()
    masks = _masks(*tables_for(count, radius))
    keyed = prints.select(
        "fp",
        F.expr("bit_count(fp)").alias("pop"),
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("t", "v"),
    )
    band = F.floor(F.col("pop") / (radius + 1)).cast("int")
    sizes = keyed.groupBy("t", "v", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    large = (
        sizes.groupBy("t", "v")
        .agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / tile).cast("int")))).alias("salts"))
        .where(F.col("total") > tile)
        .select("t", "v", "salts")
    )
    dealt = keyed.withColumn("band", band).join(large, ["t", "v"], "left")
    small = dealt.where("salts IS NULL").select(F.xxhash64("t", "v").alias("tile"), "fp")
    # Of a large bucket, the tile (band, salt) meets every tile of its own band and of the bands beside it.
    own = F.pmod(F.xxhash64("fp"), F.col("salts")[F.col("band")])
    grid = (
        dealt.where("salts IS NOT NULL")
        .withColumn("salt", own)
        .withColumn("other", F.explode(F.expr("filter(array(band - 1, band, band + 1), x -> salts[x] IS NOT NULL)")))
        .withColumn("other_salt", F.explode(F.expr("sequence(0, salts[other] - 1)")))
        .select("t", "v", "fp", F.struct("band", F.col("salt").cast("int").alias("salt")).alias("x"), F.struct(F.col("other").alias("band"), F.col("other_salt").alias("salt")).alias("y"))
        .select(F.xxhash64("t", "v", F.least("x", "y"), F.greatest("x", "y")).alias("tile"), "fp")
    )
    n = max(partitions(spark), -(-count * len(masks) // 500_000))
    tiles = small.union(grid).repartition(n, "tile").sortWithinPartitions("tile")
    return tiles.mapInArrow(_compare(radius), "a bigint, b bigint")


def near_components(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``fp`` and ``root`` (a fingerprint that names its component), only for fingerprints that have a link."""
    found = components(links(prints, radius))
    return found.select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row for each input row: doc_id, ``fingerprint`` (16 hex digits) and ``component_id``, the least doc_id reachable.

    Texts are compared whole, lower-cased in A-Z only. Rows with equal fingerprints link, those of null and blank texts
    (fingerprint zero) too. Null ids are passed over when the least id is taken; a component with none has a null one.
    Repeated rows give repeated rows; an empty table an empty result. Other columns are ignored.
    """
    rows = checkpointed(with_fingerprints(docs.select("doc_id", "text"), width).select("doc_id", "fp"))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = near_components(nodes.select("fp"), radius)
    linked = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = checkpointed(linked)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_unique(linked, least, "root").select("fp", "component_id")
    out = join_unique(rows, named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(text: str | None, width: int) -> tuple[int, int]:
    """128 bits: the SimHash of the shingles' hashes, and that of the hashes mixed anew."""
    digests = shingle_digests(text, width)
    hashes = np.frombuffer(digests, ">u8").astype(np.uint64)
    hashes = np.unique(hashes)
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return tuple(_bits(h.astype(">u8").view(np.uint8).reshape(-1, 8)) for h in (hashes, mixed ^ (mixed >> np.uint64(31))))


def jaccard(a: str | None, b: str | None, width: int) -> float:
    """The similarity of the sets of shingles of two texts; 1.0 if both have none."""
    x, y = (np.unique(np.frombuffer(shingle_digests(t, width), np.uint64)) for t in (a, b))
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def flip_chance(similarity: float) -> float:
    """The chance that a bit differs between two sets of one size with that Jaccard similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


def sampled_tables(count: int, similarity: float) -> tuple[int, int, int]:
    """Bits of a table's key, tables, and the radius (of 128 bits) that a pair at the threshold passes with 4 sigma."""
    p = flip_chance(similarity)
    bits = max(SAMPLED, ceil(log2(max(1, count) / MEAN_BUCKET)))
    tables = ceil(log(MISSED) / log(1 - (1 - p) ** bits))
    return bits, tables, ceil(128 * p + 4 * (128 * p * (1 - p)) ** 0.5)


def _keys(bits: int, tables: range):
    """An Arrow map of (lo, hi, grp) to (tile, lo, hi, grp), once for each of the tables with these numbers."""
    rng = np.random.default_rng(5)
    drawn = [rng.choice(128, bits, replace=False) for _ in range(tables.stop)][tables.start :]
    masks = np.array([[sum(1 << int(b) for b in d if b < 64), sum(1 << int(b) - 64 for b in d if b >= 64)] for d in drawn], np.uint64).reshape(-1, 2)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lo, hi = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        salt = np.arange(tables.start + 1, tables.stop + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        key = ((lo[:, None] & masks[:, 0]) + salt) * np.uint64(0xBF58476D1CE4E5B9)
        key = ((key ^ (key >> np.uint64(31))) + (hi[:, None] & masks[:, 1])) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(30)
        rows = [np.repeat(c.to_numpy(zero_copy_only=False), len(tables)) for c in batch.columns]
        return pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), *map(pa.array, rows)], names=["tile", "lo", "hi", "grp"])

    return run


def _candidates(lo: np.ndarray, hi: np.ndarray, radius: int, grp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the ends of pairs up to ``radius`` of up to a few thousand fingerprints, and whether their group is dense.

    Rows with one ``grp`` (0: none) are one node, whose own pairs are left out. Of a group (what the pairs connect) with up to
    SPARSE pairs a node, all pairs. Of a dense one a least spanning forest of its nodes.
    """
    n = len(lo)
    _, node = np.unique(np.where(grp == 0, -1 - np.arange(n), np.unique(grp, return_inverse=True)[1]), return_inverse=True)
    far = np.uint8(255)
    gap = np.empty((n, n), np.uint8)
    for at in range(0, n, 128):  # in strips, as the exclusive-ors are eight times as wide as their counts
        part = slice(at, at + 128)
        gap[part] = np.bitwise_count(lo[part, None] ^ lo[None, :]) + np.bitwise_count(hi[part, None] ^ hi[None, :])
        gap[part][node[part, None] == node[None, :]] = far
    gap[gap > radius] = far
    degree = (gap != far).sum(axis=1)
    i, j, label = _least_forest(gap.copy(), radius, node)
    nodes = np.bincount(label[np.unique(node, return_index=True)[1]], minlength=n)
    dense = np.bincount(label, degree, n) > 2 * SPARSE * nodes
    x, y = np.nonzero(np.triu(gap != far, 1) & ~dense[label][:, None])
    i, j = i[dense[label[i]]], j[dense[label[i]]]
    return np.concatenate((x, i)), np.concatenate((y, j)), np.repeat((False, True), (len(x), len(i)))


def _least_forest(gap: np.ndarray, radius: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the ends of a least spanning forest of the rows' nodes by the distances ``gap`` (overwritten), and the tree of each row."""
    n = len(gap)
    far = np.uint8(255)
    label = node.copy()
    ends: tuple[list[int], list[int]] = [], []
    while True:
        gap[label[:, None] == label[None, :]] = far
        near = gap.argmin(axis=1)
        least = gap[np.arange(n), near]
        order = np.lexsort((np.arange(n), least, label))
        heads = order[np.concatenate(([True], label[order][1:] != label[order][:-1]))]
        joined = False
        for i in heads[least[heads] <= radius]:
            a, b = label[i], label[near[i]]
            if a != b:
                ends[0].append(int(i))
                ends[1].append(int(near[i]))
                label[label == max(a, b)] = min(a, b)
                joined = True
        if not joined:
            return np.array(ends[0], np.int64), np.array(ends[1], np.int64), label


def _wide_compare(radius: int):
    """An Arrow map over rows (tile, lo, hi, grp) sorted by these: pairs up to ``radius`` as (lo, hi, lo2, hi2, dense).

    A batch's rows are compared within their buckets by their distance in the sorted order, all buckets at once; a bucket with
    several pairs, or with many rows (2 x WIDE_TILE or so at most), returns all pairs of its sparse groups and a forest of
    each dense one. Pairs within one ``grp`` (0: none) are left out.
    """

    def links_of(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, grp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        low = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        size = np.diff(np.concatenate((low, [len(keys)])))
        number = np.repeat(np.arange(len(low)), size)
        near = np.zeros(len(low), np.int64)
        small = size <= 64
        places = np.flatnonzero(small[number])
        found = []
        for step in range(1, int(size[small].max(initial=1))):
            i = places[places + step < len(keys)]
            i = i[keys[i] == keys[i + step]]
            if not len(i):
                break
            gap = np.bitwise_count(lo[i] ^ lo[i + step]) + np.bitwise_count(hi[i] ^ hi[i + step])
            i = i[(gap <= radius) & ((grp[i] == 0) | (grp[i] != grp[i + step]))]
            np.add.at(near, number[i], 1)
            found.append((i, i + step))
        if found:
            i, j = (np.concatenate(x) for x in zip(*found))
            single = near[number[i]] <= 2
            i, j = i[single], j[single]
            yield np.stack([lo[i], hi[i], lo[j], hi[j]]), np.zeros(len(i), bool)
        for k in np.flatnonzero((near > 2) | ~small):
            part = slice(low[k], low[k] + size[k])
            x, y, dense = _candidates(lo[part], hi[part], radius, grp[part])
            yield np.stack([lo[part][x], hi[part][x], lo[part][y], hi[part][y]]), dense

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the last bucket so far
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not rows.shape[1]:
                continue
            if held and held[-1][0, -1] == rows[0, -1]:
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows], axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            held = [rows[:, cut:]]
            yield from out(rows[:, :cut])
        if held:
            yield from out(np.concatenate(held, axis=1))

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1] > 1:
            for x, dense in links_of(rows[0], rows[1].view(np.uint64), rows[2].view(np.uint64), rows[3]):
                if x.shape[1]:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in x), pa.array(dense)], names=["lo", "hi", "lo2", "hi2", "dense"])

    return run


def similar_links(prints: DataFrame, texts: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows a and b (of the type of ``key``) that connect the texts whose sets of shingles have that similarity or more.

    ``prints`` has a ``key`` (distinct, not null) and the columns lo and hi of ``with_wide_fingerprints``; ``texts`` has key
    and text. Links are exact and connect what all links would; those of the tables come as stars, each text with the least key
    that they connect it to. A pair at the threshold meets in no table with a chance of MISSED at most, a closer one far more rarely. All pairs that meet within the radius are confirmed, in dense groups only
    as far as the links confirmed before leave them apart. Of keys with one wide fingerprint the least one enters the tables,
    and the others count as of its dense group.

    The FIRST tables come first, large buckets in them by tiles that don't meet one another yet. What their links and dense
    groups connect is one node for all that follows: all of it is compared in the end, so its pairs need not be returned by
    every table and every two tiles, which would be as many as the square of a group that fills large buckets.
    """
    first = checkpointed(prints.groupBy("lo", "hi").agg(F.min("key").alias("key"), (F.count(F.lit(1)) > 1).alias("shared")))
    count = first.count()
    bits, tables, radius = sampled_tables(count, similarity)
    head, rest = range(min(FIRST, tables)), range(min(FIRST, tables), tables)
    same = prints.select("key", "lo", "hi").join(first.withColumnRenamed("key", "a"), ["lo", "hi"]).where("key <> a").select("a", F.col("key").alias("b"), F.lit(True).alias("dense"))
    alone = first.withColumn("grp", F.lit(0).cast("long"))
    keyed = _keyed(alone, bits, head)
    large = _large(keyed)
    candidates = checkpointed(_met(alone, keyed, large, radius, False, count * len(head)).union(same))
    sure = _confirmed(candidates, texts, width, similarity)
    dense = candidates.where("dense").select("a", "b")

    stars = components(dense.union(sure))
    groups = stars.select(F.col("node").alias("key"), F.xxhash64("root").alias("grp"))
    grouped = checkpointed(first.join(groups, "key", "left").withColumn("grp", F.coalesce("grp", F.lit(0))))
    keyed = _keyed(grouped, bits, rest)
    larger = _large(keyed)
    if not large.isEmpty():
        keyed = keyed.union(_keyed(grouped, bits, head).join(large, "tile", "left_semi"))
        larger = larger.union(large)
    candidates = checkpointed(_met(grouped, keyed, larger, radius, True, count * tables))
    more = _confirmed(candidates, texts, width, similarity)
    sure = sure.union(more)
    newly = candidates.where("dense").select("a", "b")
    if dense.isEmpty() and newly.isEmpty():
        return sure
    parts = components(sure)
    groups = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(newly).union(more))
    return parts.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_links_left(groups, parts, texts, width, similarity))


def _keyed(rows: DataFrame, bits: int, tables: range) -> DataFrame:
    return rows.select("lo", "hi", "grp").mapInArrow(per_batch(_keys(bits, tables), 4096), "tile bigint, lo bigint, hi bigint, grp bigint")


def _large(keyed: DataFrame) -> DataFrame:
    """The buckets of more than WIDE_TILE rows, and the salts that their rows are dealt to."""
    large = keyed.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE_TILE)
    return checkpointed(large.select("tile", F.ceil(F.col("n") / WIDE_TILE).alias("salts")))


def _met(rows: DataFrame, keyed: DataFrame, large: DataFrame, radius: int, across: bool, most: int) -> DataFrame:
    """Keys a and b of pairs of ``rows`` (key, lo, hi, shared, grp) that meet within the radius in a bucket, and whether they are of a dense group.

    The rows of a large bucket are salted. If ``across``, each salt meets each other in a tile of its own, else only itself.
    ``keyed`` has ``most`` rows or fewer.
    """
    dealt = keyed.join(F.broadcast(large) if large.count() <= 50_000 else large, "tile", "left")
    dealt = dealt.withColumn("own", F.coalesce(F.pmod(F.xxhash64("lo", "hi"), F.col("salts")), F.lit(0)))
    others = F.when(F.col("salts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.expr("sequence(0L, salts - 1)"))
    dealt = dealt.withColumn("other", F.explode(others) if across else F.col("own"))
    salted = F.xxhash64("tile", F.least("own", "other"), F.greatest("own", "other"))
    tiles = dealt.select(F.when(F.col("salts").isNull(), F.col("tile")).otherwise(salted).alias("tile"), "lo", "hi", "grp")
    n = max(partitions(rows.sparkSession), -(-most // 1_000_000))
    tiles = tiles.repartition(n, "tile").sortWithinPartitions("tile", "lo", "hi")
    pairs = tiles.mapInArrow(_wide_compare(radius), "lo bigint, hi bigint, lo2 bigint, hi2 bigint, dense boolean")
    ends = [F.struct("lo", "hi"), F.struct(F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))]
    pairs = pairs.groupBy(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).agg(F.max("dense").alias("dense"))
    one = rows.select(F.struct("lo", "hi").alias("x"), F.col("key").alias("a"), F.col("shared").alias("shared_a"))
    two = rows.select(F.struct("lo", "hi").alias("y"), F.col("key").alias("b"), F.col("shared").alias("shared_b"))
    return pairs.join(one, "x").join(two, "y").select("a", "b", F.expr("dense OR shared_a OR shared_b").alias("dense"))


def _confirmed(candidates: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a and b) of ``candidates`` whose whole texts have that similarity or more."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = join_unique(join_unique(candidates, left, "a"), right, "b", counted=candidates).select("a", "b", "text_a", "text_b")

    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [jaccard(a, b, width) >= similarity for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays(batch.columns[:2], schema=pa.schema([batch.schema.field(0), batch.schema.field(1)])).filter(pa.array(keep, pa.bool_()))

    return checkpointed(both.mapInArrow(per_batch(confirm, 256), StructType(both.schema.fields[:2])))


def _links_left(groups: DataFrame, parts: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a and b) that with ``parts`` connect all that is similar within one of ``groups``; both are of ``components``.

    Only groups of several parts are read. There each row outside the group's largest part meets all others, in a
    grid of tiles of SIDE shingles or so a side.
    """
    spark = groups.sparkSession
    groups = groups.select(F.col("node").alias("key"), F.xxhash64("root").alias("grp"))
    parts = parts.select(F.col("node").alias("key"), "root")
    rows = checkpointed(groups.join(parts, "key", "left").select("key", "grp", F.xxhash64(F.coalesce("root", "key")).alias("part")))
    sizes = rows.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    apart = sizes.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rows = rows.join(apart, "grp").select("key", "grp", "part", (F.col("part") == F.col("most")).alias("main"))
    at = rows.join(texts, "key").select("key", "grp", "part", "main", "text")

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(np.frombuffer(shingle_digests(x, width), np.uint64)).tobytes() for x in batch.column(4).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["key", "grp", "part", "main", "digests"])

    rows = checkpointed(at.mapInArrow(per_batch(digest), StructType(at.schema.fields[:4]).add("digests", "binary")))
    shingles = lambda which: F.greatest(F.ceil(F.sum(F.when(which, F.octet_length("digests") / 8)) / SIDE), F.lit(1)).cast("int")
    salts = rows.groupBy("grp").agg(shingles(~F.col("main")).alias("rest"), shingles(F.col("main")).alias("mains"))
    # Salts from 0 are of the rest, those from ``rest`` on of the largest part, whose rows need not meet one another.
    dealt = rows.join(salts, "grp").withColumn("own", F.expr("if(main, rest + pmod(xxhash64(key), mains), pmod(xxhash64(key), rest))").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, if(main, rest, rest + mains) - 1)")))
    tiles = dealt.select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "part", "main", "key", "digests")
    tiles = tiles.repartition(max(partitions(spark), 32), "tile").sortWithinPartitions("tile")
    return tiles.mapInArrow(_confirm_tiles(similarity), StructType().add("a", groups.schema["key"].dataType).add("b", groups.schema["key"].dataType))


def _confirm_tiles(similarity: float):
    """An Arrow map over rows (tile, part, main, key, digests) sorted by ``tile``: the keys of links that connect parts."""

    def links_of(rows: pa.Table) -> pa.Table:
        part = rows.column(1).to_numpy()
        main = rows.column(2).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column(4).to_pylist()]
        left, right = parted(part, np.flatnonzero(~main), sets, similarity)
        keys = rows.column(3)
        return pa.table([keys.take(pa.array(left, pa.int64())), keys.take(pa.array(right, pa.int64()))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            tiles = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)] if len(tiles) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and tiles[a] != last:
                    yield from links_of(pa.Table.from_batches(held)).combine_chunks().to_batches()
                    held = []
                last = tiles[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from links_of(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return run


def parted(part: np.ndarray, rest: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Places of the ends of links that connect all parts with a link between them that has an end in ``rest``.

    ``sets`` are sorted arrays without repeats; all pairs of different parts are counted over the lists of rows by shingle.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    values, code, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    lists = row[np.argsort(code, kind="stable")]
    start = np.cumsum(count) - count
    first = np.cumsum(size) - size
    _, label = np.unique(part, return_inverse=True)
    ends: tuple[list[int], list[int]] = [], []
    for i in rest.tolist():
        own = code[first[i] : first[i] + size[i]]
        own = own[count[own] > 1]
        length = count[own]
        before = np.cumsum(length) - length
        places = np.repeat(start[own] - before, length) + np.arange(int(length.sum()))
        both = np.bincount(lists[places], minlength=n)
        union = size + size[i] - both
        both[union == 0] = union[union == 0] = 1
        near = np.flatnonzero((both / union >= similarity) & (label != label[i]))
        found, at = np.unique(label[near], return_index=True)
        if len(found):
            ends[0].extend([i] * len(found))
            ends[1].extend(near[at].tolist())
            label[np.isin(label, found)] = label[i]
            if (label == label[0]).all():
                break
    return ends


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those that are linked, directly or over others, to a row with a smaller doc_id.

    Texts link when their sets of shingles of ``width`` words, lower-cased in A-Z, have that Jaccard similarity or more; blank
    texts link with each other. A null id sorts first. Repeated rows (one id, one text) leave one. All columns are returned,
    no others; an empty table gives an empty result.
    """
    key = fresh(docs, "__key")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))
    slim = with_wide_fingerprints(keyed.select(F.col(key).alias("key"), "text"), width).select("key", "lo", "hi")
    slim = checkpointed(slim.dropDuplicates(["key"]))
    rows = keyed.dropDuplicates([key])
    found = components(similar_links(slim, rows.select(F.col(key).alias("key"), "text"), width, similarity))
    gone = found.where("node <> root").select(F.col("node").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def with_wide_fingerprints(docs: DataFrame, width: int = 5, text_col: str = "text", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """All columns of ``docs`` and two long columns with the 128-bit SimHash; both 0 for texts without a word.

    Columns that are named ``lo`` or ``hi`` already are replaced.
    """
    docs = docs.drop(lo, hi)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [wide_fingerprint(x, width) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1))], names=[*batch.schema.names, lo, hi])

    return docs.mapInArrow(per_batch(run), StructType([*docs.schema.fields]).add(lo, LongType()).add(hi, LongType()))


def table_count(count: int, radius: int) -> int:
    blocks, chosen = tables_for(count, radius)
    return comb(blocks, chosen)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
