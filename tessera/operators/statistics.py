"""Descriptive statistics, percentiles, group comparison and agreement."""

from __future__ import annotations

from math import erfc, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType
from pyspark.sql.window import Window

from tessera.functions.numbers import finite, half_up, reader_unit, t_critical

METRICS = ("likert_mean", "structure_score", "finding_coverage")
#: The metrics of a payload that enter statistics, and its bookkeeping fields that never do.
STATISTIC_METRICS = ("likert_mean", "structure_score", "finding_coverage", "precision", "recall", "score", "error_rate", "agreement", "overall_score")


def payload_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric and value of all STATISTIC_METRICS, from the map ``metrics``, else ``composite_inputs``, else the row's own columns.

    The first of the two maps that is not null is the whole payload, even if it lacks a metric. Columns that are not there
    count as null; null and non-finite values are left out.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    own = F.create_map(*(x for m in STATISTIC_METRICS if m in kinds and isinstance(kinds[m], NumericType) for x in (F.lit(m), F.col(m).cast("double"))))
    maps = [F.col(c).cast("map<string,double>") for c in ("metrics", "composite_inputs") if c in kinds]
    payload = F.coalesce(*maps, own.cast("map<string,double>"))
    out = rows.select(*keys, F.explode(payload).alias("metric", "value"))
    return out.where(F.col("metric").isin(*STATISTIC_METRICS) & finite(F.col("value")))


def unpivoted(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """keys, metric, value, without null and non-finite values."""
    return rows.unpivot(keys, list(metrics), "metric", "value").where(finite(F.col("value")))


def describe(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, sample deviation (0 for one value), min, max and a 95 % t interval (null for one value)."""
    out = rows.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    half = F.when(F.col("n") > 1, t_critical(F.col("n")) * F.col("std") / F.sqrt(F.col("n")))
    r = lambda c, name: half_up(c).alias(name)
    return out.select(*keys, "n", r(F.col("mean"), "mean"), r(F.col("std"), "std"), r(F.col("min"), "min"), r(F.col("max"), "max"), r(F.col("mean") - half, "ci_lower"), r(F.col("mean") + half, "ci_upper"))


def overall_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The mean over all values of the three metrics together, likert on 0 to 1."""
    values = unpivoted(rows, keys)
    unit = F.when(F.col("metric") == "likert_mean", reader_unit(F.col("value"))).otherwise(F.col("value"))
    return values.groupBy(*keys).agg(half_up(F.avg(unit)).alias("overall_score"), F.count(F.lit(1)).alias("n_values"))


def midrank_percentile(rows: DataFrame, value: str = "value") -> DataFrame:
    """100 (below + equal / 2) / n of each row among the finite values; 0.0 for others.

    Values are counted first, then dealt to ranges; what lies below a range is summed over one row for each of them.
    """
    counts = rows.where(finite(F.col(value))).groupBy(value).agg(F.count(F.lit(1)).alias("__eq"))
    ranged = counts.repartitionByRange(value).withColumn("__part", F.spark_partition_id())
    parts = ranged.groupBy("__part").agg(F.sum("__eq").alias("__in"))
    line = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    before = parts.select("__part", F.coalesce(F.sum("__in").over(line), F.lit(0)).alias("__before"), F.sum("__in").over(Window.partitionBy()).alias("__n"))
    inside = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__below", F.coalesce(F.sum("__eq").over(inside), F.lit(0))).join(F.broadcast(before), "__part")
    ranks = placed.select(value, half_up(100.0 * (F.col("__before") + F.col("__below") + 0.5 * F.col("__eq")) / F.col("__n")).alias("percentile"))
    return rows.join(ranks, value, "left").withColumn("percentile", F.coalesce("percentile", F.lit(0.0)))


def ordered_pair_counts(rows: DataFrame, group: str, order: str, first: Column, second: Column, width: int = 4096) -> DataFrame:
    """``first``, ``second`` and ``n``: in how many pairs of rows of one group the row with the smaller ``order`` (an integer) has that first and the other that second.

    No pair is made: rows are counted by value, then what lies below is summed over ranges of ``width`` and within each range.
    Different values of ``first`` are few. Rows with a null group or order are in no pair, nor are two of one order.
    """
    at = F.col(order).cast("long")
    placed = rows.where(F.col(group).isNotNull() & at.isNotNull()).select(F.col(group).alias("grp"), (at - F.pmod(at, F.lit(width))).alias("part"), at.alias("at"), first.alias("first"), second.alias("second"))
    counts = placed.groupBy("grp", "part", "at", "first", "second").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("grp", "first").distinct()

    def below(keys: list[str], place: str) -> DataFrame:
        ones = counts.groupBy(*keys, place, "first").agg(F.sum("n").alias("ones"))
        twos = counts.groupBy(*keys, place, "second").agg(F.sum("n").alias("twos")).join(firsts, "grp")
        line = Window.partitionBy(*keys, "first").orderBy(place).rangeBetween(Window.unboundedPreceding, -1)
        summed = ones.unionByName(twos, allowMissingColumns=True).select("first", "second", "twos", F.sum("ones").over(line).alias("before"))
        return summed.where("twos > 0 AND before > 0").select("first", "second", (F.col("twos") * F.col("before")).alias("n"))

    return below(["grp"], "part").union(below(["grp", "part"], "at")).groupBy("first", "second").agg(F.sum("n").alias("n"))


def weighted_means(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """The weighted mean of each metric; models without a weight count once; metrics without weight are left out."""
    joined = unpivoted(rows, [*keys, "model"]).join(weights, "model", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    out = joined.groupBy(*keys, "metric").agg(F.sum(F.col("value") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    return out.where("w <> 0").select(*keys, "metric", half_up(F.col("s") / F.col("w")).alias("weighted_mean"))


@F.pandas_udf(DoubleType())
def _two_tails(t: pd.Series) -> pd.Series:
    return t.map(lambda x: erfc(abs(x) / sqrt(2)), na_action="ignore")


def ordinal_weights(models: DataFrame, weights: list[float]) -> DataFrame:
    """model and weight by the place of its name among all models; models beyond the list have no weight."""
    line = Window.orderBy("model")  # a dimension of models
    ranked = models.select("model").distinct().withColumn("__at", F.row_number().over(line))
    return ranked.where(F.col("__at") <= len(weights)).select("model", F.element_at(F.array(*map(F.lit, weights)), F.col("__at")).alias("weight"))


def welch_p(n_a: Column, mean_a: Column, var_a: Column, n_b: Column, mean_b: Column, var_b: Column) -> Column:
    """Two-sided p of Welch's t by the normal tail; 1 with fewer than two values on a side; without spread 0, or 1 if equal."""
    error = F.sqrt(var_a / n_a + var_b / n_b)
    p = F.when(error == 0, F.when(mean_a != mean_b, 0.0).otherwise(1.0)).otherwise(_two_tails((mean_a - mean_b) / F.nullif(error, F.lit(0.0))))
    return F.when((n_a >= 2) & (n_b >= 2), p).otherwise(F.lit(1.0))


def welch(groups: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Welch's t and its two-sided p for each pair of groups (n, mean, var) with the same keys, and the method.

    With fewer than two values on a side the method is insufficient_data, t null and p 1.
    """
    left = groups.select(*keys, *(F.col(c).alias(f"{c}_a") for c in (name, "n", "mean", "var")))
    right = groups.select(*keys, *(F.col(c).alias(f"{c}_b") for c in (name, "n", "mean", "var")))
    pairs = left.join(right, keys).where(F.col(f"{name}_a") < F.col(f"{name}_b"))
    error = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    t = F.when(enough & (error > 0), (F.col("mean_a") - F.col("mean_b")) / error)
    p = welch_p(*(F.col(f"{c}_{g}") for g in "ab" for c in ("n", "mean", "var")))
    method = F.when(enough, "welch_normal_approximation").otherwise("insufficient_data")
    return pairs.select(*keys, f"{name}_a", f"{name}_b", "n_a", "n_b", t.alias("t"), p.alias("p"), method.alias("method"))


def holm(rows: DataFrame, p: str, keys: list[str]) -> DataFrame:
    """Adds ``p_holm``: step-down adjusted p values within ``keys``; a null, non-finite or outside p counts as 1."""
    clean = F.when(finite(F.col(p)) & F.col(p).between(0, 1), F.col(p)).otherwise(F.lit(1.0))
    order = Window.partitionBy(*keys).orderBy("__p", *[c for c in rows.columns if c not in keys and c != p])
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    stepped = rows.withColumn("__p", clean).withColumn("__a", F.least(F.lit(1.0), (count - F.row_number().over(order) + 1) * F.col("__p")))
    running = F.max("__a").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("p_holm", running).drop("__p", "__a")


def hazard_weighted(rows: DataFrame, value: str, weights: dict[tuple[str, int], float], keys: list[str], default: float = 1.0) -> DataFrame:
    """n and the mean of value times the weight of its error type and level; pairs without a weight count ``default``."""
    weight = F.lit(default)
    for (kind, level), w in weights.items():
        weight = F.when((F.col("error_type") == kind) & (F.col("level") == level), w).otherwise(weight)
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), half_up(F.avg(F.col(value) * weight)).alias("weighted"))
    return out


def side_differences(rows: DataFrame, item: str, one: Column, two: Column, keys: list[str]) -> DataFrame:
    """For each key what only one side names and what only the other does, sorted and joined by semicolons, and whether both name the same."""
    seen = rows.groupBy(*keys, item).agg(F.bool_or(one).alias("__a"), F.bool_or(two).alias("__b"))
    listed = lambda keep: F.array_join(F.array_sort(F.collect_list(F.when(keep, F.col(item)))), ";")
    out = seen.groupBy(*keys).agg(listed(F.col("__a") & ~F.col("__b")).alias("only_one"), listed(F.col("__b") & ~F.col("__a")).alias("only_two"))
    return out.withColumn("exact", (F.col("only_one") == "") & (F.col("only_two") == ""))


def level_agreement(rows: DataFrame, a: str, b: str, keys: list[str], action_a: str | None = None, action_b: str | None = None) -> DataFrame:
    """Compared, exact and within-one counts of two levels and their rates; with actions also how often these agree."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = [F.count(F.lit(1)).alias("compared"), F.count_if(F.col(a) == F.col(b)).alias("exact"), F.count_if(F.abs(F.col(a) - F.col(b)) <= 1).alias("within_one")]
    names = ["exact", "within_one"]
    if action_a and action_b:
        counts.append(F.count_if(F.col(action_a).eqNullSafe(F.col(action_b))).alias("action"))
        names.append("action")
    out = known.groupBy(*keys).agg(*counts)
    return out.withColumns({f"{n}_rate": half_up(F.col(n) / F.col("compared"), 4) for n in names})


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed and expected agreement, kappa, the number of categories, and status: complete, or undefined without a kappa.

    With expected 1 kappa is 1 if observed is 1, else null.
    """
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    one = cells.groupBy(F.col("a").alias("x")).agg(F.sum("n").alias("na"))
    two = cells.groupBy(F.col("b").alias("x")).agg(F.sum("n").alias("nb"))
    both = one.join(two, "x", "full")
    chance = both.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("categories"))
    out = total.join(F.broadcast(chance)).select("n", "categories", (F.col("same") / F.col("n")).alias("o"), (F.col("c") / (F.col("n") * F.col("n"))).alias("e"))
    kappa = F.when(F.col("e") == 1, F.when(F.col("o") == 1, 1.0)).otherwise((F.col("o") - F.col("e")) / (1 - F.col("e")))
    status = F.when(kappa.isNull(), "undefined").otherwise("complete")
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), half_up(F.col("o")).alias("observed"), half_up(F.col("e")).alias("expected"), half_up(kappa).alias("kappa"), "categories", status.alias("status"))


def weighted_kappa(pairs: DataFrame, a: str, b: str, low: int, high: int) -> DataFrame:
    """Kappa with quadratic weights on the scale low..high, from the contingency table."""
    scale = float(high - low)
    cells = pairs.where(F.col(a).between(low, high) & F.col(b).between(low, high)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    weight = 1 - ((F.col("a") - F.col("b")) / scale) * ((F.col("a") - F.col("b")) / scale)
    seen = cells.agg(F.sum("n").alias("n"), F.sum(weight * F.col("n")).alias("o"))
    one, two = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = one.join(F.broadcast(two)).agg(F.sum(weight * F.col("na") * F.col("nb")).alias("e"))  # at most (high - low + 1) squared rows
    out = seen.join(F.broadcast(chance)).select("n", (F.col("o") / F.col("n")).alias("o"), (F.col("e") / (F.col("n") * F.col("n"))).alias("e"))
    return out.select("n", half_up(F.col("o")).alias("observed"), half_up(F.col("e")).alias("expected"), half_up((F.col("o") - F.col("e")) / (1 - F.col("e"))).alias("kappa"))


def peer_gap(rows: DataFrame, who: str) -> DataFrame:
    """Each member's mean of a metric beside the mean of the other members' means; null without others."""
    means = rows.groupBy(who, "metric").agg(F.avg("value").alias("m"))
    all_ = Window.partitionBy("metric")
    peers = (F.sum("m").over(all_) - F.col("m")) / F.nullif(F.count("m").over(all_) - 1, F.lit(0))
    return means.select(who, "metric", half_up(F.col("m")).alias("mean"), half_up(peers).alias("peer_mean"), half_up(F.col("m") - peers, 4).alias("gap"))
