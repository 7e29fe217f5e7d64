"""Approximate nearest neighbours by additive quantisation (operator 8).

Codebooks of full-dimensional vectors are trained on a bounded sample, each on what the ones before leave over. A beam search
encodes every vector as one entry of each codebook and stores the codes with the norm of their sum. A query makes one table of
dot products for each codebook; a vector's approximate distance is its norm minus twice the sum of its table entries.

The index is dealt into slices, and the queries are rows too: each goes to every slice, where the rows of the index come first
and the queries stream by. So a task holds one slice, whatever the number of queries. In a slice the best by approximate
distance are ranked again by exact distances on the original vectors, and the slices' results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import checkpointed, partitions, per_batch, table, unit_hash

BOOKS, ENTRIES, BEAM = 24, 256, 4
#: Vectors that the codebooks are trained on, the bound of what the driver holds.
SAMPLE = 8192
#: Rows of a slice of the index at most (in the mean), and rows of such a slice that are ranked exactly for a query; of a smaller
#: slice a share of them, but LEAST times k at least. So recall does not fall as the table grows.
SLICE, SHORTLIST, LEAST = 1 << 17, 400, 8
#: Queries that are scored at once.
BLOCK = 256


def train(vectors: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 12, seed: int = 8) -> np.ndarray:
    """Codebooks (books, entries, dimension): k-means on the residuals of the books before. float64, seeded."""
    rng = np.random.default_rng(seed)
    rest = vectors.astype(np.float64)
    out = np.zeros((books, entries, vectors.shape[1]))
    if not len(rest):
        return out
    for b in range(books):
        book = rest[rng.choice(len(rest), entries, replace=len(rest) < entries)]
        for _ in range(rounds):
            near = _nearest(rest, book)
            sums = np.zeros_like(book)
            np.add.at(sums, near, rest)
            sizes = np.bincount(near, minlength=entries)
            book = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], rest[rng.choice(len(rest), entries)])
        out[b] = book
        rest = rest - book[_nearest(rest, book)]
    return out


def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * rows @ book.T).argmin(axis=1)


def encode(vectors: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) as uint8 and the squared norm of each reconstruction, by a beam search over the books in order."""
    rows, (books, entries, _) = len(vectors), codebooks.shape
    codes = np.zeros((rows, 1, books), np.uint8)
    rest = vectors.astype(np.float32)[:, None, :]
    for b in range(books):
        book = codebooks[b].astype(np.float32)
        cost = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(axis=1)
        flat = cost.reshape(rows, -1)
        width = min(beam if b < books - 1 else 1, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        kept, entry = best // entries, best % entries
        codes = np.take_along_axis(codes, kept[:, :, None], axis=1)
        codes[:, :, b] = entry
        rest = np.take_along_axis(rest, kept[:, :, None], axis=1) - book[entry]
    norms = ((vectors.astype(np.float64) - rest[:, 0, :]) ** 2).sum(axis=1)
    return codes[:, 0, :], norms


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (array of float) of the rows that take part: no null, zero or non-finite vector, and of the commonest length."""
    v = F.col("__v")
    rows = vectors.select(F.col(id_col).alias("__i"), F.col(vector_col).alias("__v")).where(
        "__i IS NOT NULL AND __v IS NOT NULL AND size(__v) > 0 AND forall(__v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(__v, x -> x <> 0)"
    )
    size = rows.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size(v) == (size["d"] if size else 0))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def index(rows: DataFrame, books: int = BOOKS, entries: int = ENTRIES, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """All rows of ``usable`` with their ``codes`` and ``norm``, and the codebooks, whose size is bounded."""
    total = rows.count()
    part = rows.where(unit_hash(F.lit(8), "__i") < min(1.0, sample / max(1, total))).orderBy("__i").limit(2 * sample).collect()
    data = np.array([r["__v"] for r in part], np.float64)
    if not len(data):
        data = np.array([r["__v"] for r in rows.orderBy("__i").limit(sample).collect()], np.float64)
    books_ = train(data.reshape(len(data), -1), books, entries) if len(data) else np.zeros((books, entries, 1))
    sent = rows.sparkSession.sparkContext.broadcast(books_)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, norms = encode(_matrix(batch.column(1), np.float64), sent.value)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["__i", "__v", "codes", "norm"]
        )

    kind = rows.schema["__v"].dataType.simpleString()
    return rows.mapInArrow(per_batch(run, 1024), f"__i bigint, __v {kind}, codes binary, norm double"), books_


def _best(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least distances, ties to the smaller id, in order."""
    if len(ids) > k:
        edge = np.partition(distances, k - 1)[k - 1]
        places = np.flatnonzero(distances <= edge)
    else:
        places = np.arange(len(ids))
    return places[np.lexsort((ids[places], distances[places]))][:k]


class _Slice:
    """The rows of one slice of the index, ready to be searched."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids = rows.column("__i").to_numpy()
        if len(np.unique(ids)) < len(ids):  # repeated rows
            rows = rows.take(pa.array(list({(i, v): n for n, (i, v) in enumerate(zip(ids.tolist(), map(bytes, self._vectors(rows))))}.values())))
        self.ids = rows.column("__i").to_numpy()
        self.vectors = self._vectors(rows)
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.codes = np.ascontiguousarray(codes.T)
        self.norms = rows.column("norm").to_numpy().astype(np.float32)

    @staticmethod
    def _vectors(rows: pa.Table) -> np.ndarray:
        return rows.column("__v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)

    def nearest(self, query_id: int, query: np.ndarray, tables: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the k rows found nearest, each id once and the query's own left out, and their distances, in order."""
        near = self.norms.copy()
        for codes, dots in zip(self.codes, tables):
            near -= dots[codes]
        near[self.ids == query_id] = np.inf
        some = _best(near, self.ids, max(LEAST * k, -(-SHORTLIST * len(near) // SLICE)))
        some = some[np.isfinite(near[some])]
        exact = np.sqrt(((self.vectors[some].astype(np.float64) - query) ** 2).sum(axis=1))
        order = np.lexsort((self.ids[some], exact))
        ids = self.ids[some][order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return ids[first], exact[order][first]


def _searcher(sent, k: int):
    """An Arrow map over rows (slice, asked, __i, __v, codes, norm) sorted by slice, the index before the queries."""

    def answers(part: _Slice, batch: pa.RecordBatch) -> pa.RecordBatch:
        asked = batch.column(2).to_numpy(zero_copy_only=False)
        queries = _matrix(batch.column(3), np.float64)
        tables = (2 * np.einsum("qd,bed->qbe", queries, sent.value)).astype(np.float32)
        found = [part.nearest(*x, k) for x in zip(asked, queries, tables)]
        sizes = [len(ids) for ids, _ in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(asked, sizes)), pa.array(np.concatenate([ids for ids, _ in found])), pa.array(np.concatenate([d for _, d in found]))],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, part = None, [], None
        for batch in batches:
            slices = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((slices[1:] != slices[:-1]) | (asked[1:] != asked[:-1])) + 1
            cuts = [0, *edges.tolist(), len(slices)] if len(slices) else []
            for a, b in zip(cuts, cuts[1:]):
                if slices[a] != number:
                    number, held, part = slices[a], [], None
                rows = batch.slice(a, b - a)
                if not asked[a]:
                    held.append(rows)
                    continue
                if part is None and held:
                    part, held = _Slice(held), []
                if part is not None:
                    for at in range(0, rows.num_rows, BLOCK):
                        yield answers(part, rows.slice(at, BLOCK))

    return run


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in double precision) of the k nearest found.

    ``is_query`` makes a Column of the id that states the query set; every usable row but those of the query's own id is a
    candidate. Rows whose id is null, or whose vector is null, empty, zero, or has a null or non-finite component, or another
    length than most, take no part. Each id is asked once and found once: of several vectors of an id the least one asks, and
    the nearest one is found. With fewer than k candidates all are returned; ties go to the smaller id; an empty table gives
    an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(id_col).cast("long").alias(id_col), vector_col), id_col, vector_col)
    coded, books = index(rows)
    coded = checkpointed(coded)
    slices = max(-(-coded.count() // slice_rows), min(partitions(spark), 64))
    sent = spark.sparkContext.broadcast(books)
    kept = coded.select(F.pmod(F.xxhash64("__i", "__v"), F.lit(slices)).cast("int").alias("slice"), F.lit(False).alias("asked"), "__i", "__v", "codes", "norm")
    asked = coded.where(is_query(F.col("__i"))).groupBy("__i").agg(F.min("__v").alias("__v"))
    none = [F.lit(None).cast(coded.schema[c].dataType).alias(c) for c in ("codes", "norm")]
    dealt = asked.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("asked"), "__i", "__v", *none)
    both = kept.unionByName(dealt).repartition(max(partitions(spark), slices), "slice").sortWithinPartitions("slice", "asked")
    found = both.mapInArrow(_searcher(sent, k), "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
