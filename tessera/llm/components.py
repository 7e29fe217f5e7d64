"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def _least() -> Column:
    """The least b of each a, as a running first, which holds no group in memory."""
    return F.first("b").over(Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least node it knows, so that b < a in all rows; rows may repeat."""
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    seen = edges.select(F.explode(F.array(there, back)).alias("e")).select("e.a", "e.b")
    linked = seen.withColumn("m", F.least(_least(), "a")).where("b > a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its neighbours, all smaller (b < a), to the least of these."""
    linked = edges.withColumn("m", _least())
    return linked.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node in the edges (columns a and b, of one ordered type).

    Nodes without a link have no row. Each round is written to the checkpoint folder; rounds end when the stars stand still,
    after a number of rounds that grows with the logarithm of the longest path. No edges: no rows. A round is three exchanges of
    its edges: the driver's memory grows with the tasks and plans that it has to keep account of.
    """
    now = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    state = None
    while True:
        now = checkpointed(_small_star(_large_star(now)))
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sums == state:
            break
        state = sums
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
