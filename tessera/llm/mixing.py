"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 1).

The words of a source, in a seeded order, form shards; the words of a shard, in that order, form blocks of equal size. Seats,
one for each block to take, go to the sources with the highest quotients target / (2 k + 1), and a source's seats in the same
way down a tree to its shards, which gives integer quotas. In a shard with n blocks and a quota q every block is taken q // n times, and
q % n blocks chosen at a seeded phase once more. How many words a document has in the chosen blocks follows from its place
among the shard's words in closed form, so blocks are never made as rows, whatever their number.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, checkpointed, table, unit_hash

BLOCK_WORDS = 32
SHARD_WORDS = 1 << 20
REPEATS = 3
#: Children of a node of the tree down which a source's seats are handed to its shards.
FAN = 1024


def cycle_weights(sources: Sequence[str | None], weights: Sequence[int] = (5, 2, 1)) -> list[int]:
    """5, 2, 1, 5, ... for sources already in order."""
    return [weights[i % len(weights)] for i in range(len(sources))]


def fill_targets(sizes: Sequence[int], weights: Sequence[int], most: int = REPEATS) -> list[Fraction]:
    """Shares of sum(sizes) by weight, where none passes ``most`` times its size and what is above goes to the others."""
    targets = [Fraction(0)] * len(sizes)
    open_, rest = [i for i, s in enumerate(sizes) if s > 0], Fraction(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total >= most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = rest * weights[i] / total
            break
        for i in over:
            targets[i] = Fraction(most * sizes[i])
        rest -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def apportion(votes: Sequence[Fraction | int], seats: int, most: Sequence[int]) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest quotient vote / (2 k + 1); none gets more than its ``most``.

    Ties go to the earlier entry. A divisor found by bisection gives all but the last few seats at once, so the work does not
    grow with the number of seats.
    """
    votes = [Fraction(v) for v in votes]

    def at(divisor: Fraction) -> list[int]:
        return [min(m, int(v / divisor + Fraction(1, 2))) if v > 0 else 0 for v, m in zip(votes, most)]

    total = sum(votes)
    if seats <= 0 or total == 0:
        return [0] * len(votes)
    high = low = total / seats
    while sum(at(high)) > seats:
        high *= 2
    for _ in range(200):
        if sum(at(low)) >= seats or low < total / seats / 2**60:
            break
        low /= 2
    for _ in range(80):
        middle = (low + high) / 2
        middle = Fraction(round(middle * 2**40), 2**40) if middle > 1 else middle
        if sum(at(middle)) > seats:
            low = middle
        else:
            high = middle
        if sum(at(high)) >= seats - len(votes):
            break
    given = at(high)
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, given, most)) if v > 0 and g < m]
    heapq.heapify(heap)
    left = seats - sum(given)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        given[i] += 1
        left -= 1
        if given[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def _child_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("__node")
    pdf["__quota"] = apportion(pdf["__words"].tolist(), int(pdf["__seats"].iloc[0]), (REPEATS * pdf["__of"]).tolist())
    return pdf[["__source_no", "__node", "__quota"]]


def shard_quotas(totals: DataFrame, seats: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """``__source_no``, ``__shard``, ``__blocks`` and ``__quota`` (blocks to take) of each shard.

    ``totals`` has the words of each shard, ``seats`` the blocks to take of each source. The seats are handed down a tree with
    ``fan`` children to a node, by quotients at each node, so that no task holds more than ``fan`` shards.
    """
    blocks = F.ceil(F.col("__words") / BLOCK_WORDS)
    leaves = totals.select("__source_no", "__shard", "__words", blocks.cast("long").alias("__of"))
    given = seats.select("__source_no", F.lit(0).cast("long").alias("__parent"), "__seats")
    depth = 1
    while fan**depth < shards:
        depth += 1
    for level in range(depth - 1, -1, -1):
        nodes = leaves.groupBy("__source_no", F.expr(f"__shard div {fan**level}").alias("__node")).agg(F.sum("__words").alias("__words"), F.sum("__of").alias("__of"))
        nodes = nodes.withColumn("__parent", F.expr(f"__node div {fan}") if level < depth - 1 else F.lit(0).cast("long"))
        found = nodes.join(given, ["__source_no", "__parent"]).groupBy("__source_no", "__parent").applyInPandas(_child_quotas, "__source_no int, __node long, __quota long")
        given = found.select("__source_no", F.col("__node").alias("__parent"), F.col("__quota").alias("__seats"))
    quotas = given.select("__source_no", F.col("__parent").alias("__shard"), F.col("__seats").alias("__quota"))
    return leaves.select("__source_no", "__shard", F.greatest("__of", F.lit(1).cast("long")).alias("__blocks")).join(quotas, ["__source_no", "__shard"])


def _mixed(docs: DataFrame, seed: int, weigh: Callable[[Sequence[str | None]], Sequence[int]], id_col: str, text_col: str, source_col: str, whole: bool) -> DataFrame:
    """id, size, source size, target and words taken of each row, as columns ``__*``; ``whole`` keeps all columns."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        F.coalesce(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(0)).alias("__order"),
        *([F.col(c).alias(f"__own_{i}") for i, c in enumerate(docs.columns)] if whole else []),
    )
    slim = rows if whole else checkpointed(rows)
    found = slim.groupBy("__source").agg(F.sum("__size").alias("n")).collect()
    found.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
    sizes = [r["n"] for r in found]
    targets = fill_targets(sizes, weigh([r["__source"] for r in found]))
    blocks = [-(-s // BLOCK_WORDS) for s in sizes]
    seats = apportion(targets, round(sum(targets) / BLOCK_WORDS), [REPEATS * b for b in blocks])
    shards = [max(1, -(-s // SHARD_WORDS)) for s in sizes]
    schema = "__source string, __source_no int, __source_size long, __target double, __seats long, __shards long"
    plan = spark.createDataFrame([(r["__source"], i, s, float(t), q, k) for i, (r, s, t, q, k) in enumerate(zip(found, sizes, targets, seats, shards))], schema)
    if len(found) <= 100_000:
        plan = F.broadcast(plan)
    placed = slim.join(plan.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of"))).withColumn(
        "__shard", F.pmod(F.col("__order"), F.col("__shards"))
    )
    totals = checkpointed(placed.groupBy("__source_no", "__shard").agg(F.sum("__size").alias("__words")))
    quotas = shard_quotas(totals, plan.select("__source_no", "__seats"), max(shards, default=1))
    line = Window.partitionBy("__source_no", "__shard").orderBy("__order", F.col("__id").asc_nulls_first(), "__size")
    spread = placed.withColumn("__end", F.sum("__size").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(quotas, ["__source_no", "__shard"])
    phase = F.pmod(F.xxhash64(F.lit(seed), F.col("__source_no"), F.col("__shard")), F.col("__blocks"))
    spread = spread.withColumns({"__all": F.expr("__quota div __blocks"), "__more": F.expr("__quota % __blocks"), "__phase": phase})

    def upto(x: str) -> str:
        """The words taken among the first x of the shard: chosen(k) is how many of the first k blocks are chosen."""
        k = f"(({x}) div {BLOCK_WORDS})"
        chosen = lambda j: f"(({j} * __more + __phase) div __blocks)"
        return f"(({x}) * __all + {BLOCK_WORDS} * {chosen(k)} + (({x}) % {BLOCK_WORDS}) * ({chosen(f'({k} + 1)')} - {chosen(k)}))"

    taken = F.expr(f"CASE WHEN __size = 0 THEN 0L ELSE {upto('__end')} - {upto('__end - __size')} END")
    return spread.withColumn("__taken", taken)


def mix(docs: DataFrame, seed: int = 0, weigh: Callable[[Sequence[str | None]], Sequence[int]] = cycle_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each input row: id, size, source_size, target (its source's) and taken.

    ``size`` counts words ``[^\\x20\\x09-\\x0D]+`` (null: 0), ``taken`` the words of the row that the mix takes, repeats
    counted, at most ``REPEATS`` times its size. A null source is a source of its own and comes last. A source without words
    has target 0 and takes nothing. Repeated rows stay apart. Reruns agree, however the rows are partitioned; the driver
    only sees one row for each source, the sources being the mix's configuration. Other columns are ignored.
    """
    found = _mixed(docs, seed, weigh, id_col, text_col, source_col, False)
    return found.select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), F.col("__taken").alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 0, weigh: Callable[[Sequence[str | None]], Sequence[int]] = cycle_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as whole documents, with the columns of ``docs``: a row stands for as many copies as the mix takes of it.

    What is left over a whole number of copies is rounded at a seeded place for each document, so that each source's words
    come near its target. A row is returned 0 to ``REPEATS`` times. A row without words (null and blank texts too) is no part
    of the mix and stays once.
    """
    found = _mixed(docs, seed, weigh, id_col, text_col, source_col, True)
    draw = unit_hash(F.lit(seed + 1), "__order")
    copies = F.when(F.col("__size") == 0, 1).otherwise(F.floor(F.col("__taken") / F.greatest(F.col("__size"), F.lit(1)) + draw)).cast("int")
    rows = found.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.least(copies, F.lit(REPEATS)))))
    return rows.select(*(F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
