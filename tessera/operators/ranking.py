"""Top-k selection with near-cutoff rows, stratified samples, unique ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numbers import finite, half_up, ranking_unit

#: Fixed values.
WEIGHTS = {"likert_mean": 0.4, "structure_score": 0.3, "finding_coverage": 0.3}


def score(weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the metrics, rounded to 4 digits before any comparison; null if one with weight is missing."""
    unit = {m: ranking_unit(F.col(m)) if m == "likert_mean" else F.col(m) for m in weights}
    used = [m for m, w in weights.items() if w > 0]
    total = sum(unit[m] * F.lit(weights[m]) for m in used) / F.lit(sum(weights.values()) or 1.0)
    ok = F.lit(True)
    for m in used:
        ok = ok & finite(F.col(m))
    return F.when(ok, half_up(total, 4))


def top_k(rows: DataFrame, key: str, ties: list[str], k: int = 3, tolerance: float = 0.01) -> DataFrame:
    """Rows ranked by ``score`` within the key: the first k, and those within the tolerance of the k-th.

    Equal scores rank by ``ties``. Differences are compared in ten-thousandths, so engines agree.
    """
    order = Window.partitionBy(key).orderBy(F.desc("score"), *ties)
    ranked = rows.where("score IS NOT NULL").withColumn("rank", F.row_number().over(order))
    everyone = Window.partitionBy(key)
    cutoff = F.max(F.when(F.col("rank") == k, F.col("score"))).over(everyone)
    near = F.round((cutoff - F.col("score")) * 10000) <= round(tolerance * 10000)
    more = F.count(F.lit(1)).over(everyone) > k
    out = ranked.withColumns({"selected": F.col("rank") <= k, "near": near & more})
    return out.where("selected OR near").withColumn("near_cutoff_review", F.col("near") & ~F.col("selected")).drop("near")


def overlapping(rows: DataFrame, key: str, ties: list[str], low: str, high: str, k: int = 3) -> DataFrame:
    """The first k rows and those whose interval [low, high] overlaps that of the k-th row."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), *ties)
    ranked = rows.where("score IS NOT NULL").withColumn("rank", F.row_number().over(order))
    everyone = Window.partitionBy(key)
    at = lambda c: F.max(F.when(F.col("rank") == k, F.col(c))).over(everyone)
    overlap = (F.col(low) <= at(high)) & (at(low) <= F.col(high))
    return ranked.withColumn("uncertainty_overlap", F.coalesce(overlap, F.lit(False))).where((F.col("rank") <= k) | F.col("uncertainty_overlap"))


def stratified(rows: DataFrame, strata: list[str], order: str, limit: int) -> DataFrame:
    """A round-robin over the strata: the first of each, then the second of each, up to ``limit`` rows."""
    line = Window.partitionBy(*strata).orderBy(order)
    return rows.withColumn("turn", F.row_number().over(line)).where(F.col("turn") <= limit).orderBy("turn", *strata).limit(limit)


def unique_ids(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """``unique_id``: the id, with -2, -3, ... for its later rows."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(id_col).cast("string")).otherwise(F.concat(F.col(id_col).cast("string"), F.lit("-"), n.cast("string"))))
