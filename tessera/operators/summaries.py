"""Relational summaries of report routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up


def quality_counts() -> list[Column]:
    return [F.count_if(F.col("quality") == q).alias(f"quality_{q}") for q in ("passed", "failed", "unknown")]


def model_source_summary(reports: DataFrame) -> DataFrame:
    """Reports, gate results and warnings for each model, source and evidence tier."""
    return reports.groupBy("model", "source", "evidence_tier").agg(F.count(F.lit(1)).alias("report_count"), *quality_counts(), F.sum(F.size("warnings").cast("long")).alias("warning_count"))


def modality_summary(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """Cases and reports for each modality and body part; reports are counted by case first, so cases count once."""
    by_case = reports.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == "passed").alias("p"), F.count_if(F.col("quality") == "failed").alias("f"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return cases.join(by_case, "case_id", "left").groupBy("modality", "body_part").agg(F.count(F.lit(1)).alias("case_count"), zero("n")("report_count"), zero("p")("quality_passed"), zero("f")("quality_failed"))


def case_routes(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """For each case its reports, gate results, and its models, sources and tiers, each once, by first place, joined by semicolons.

    Reports are reduced to one row a case in one aggregation; a case has a few reports.
    """
    names = ("model", "source", "evidence_tier")
    lists = [F.collect_set(F.struct("pos", F.col(name).alias("x"))).alias(name) for name in names]
    by_case = reports.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *quality_counts(), *lists)
    out = cases.select("case_id", "reader").join(by_case, "case_id", "left")
    texts = [F.coalesce(F.array_join(F.array_distinct(F.transform(F.array_sort(name), lambda s: s["x"])), ";"), F.lit("")).alias(f"{name}s") for name in names]
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("quality_passed", "quality_failed", "quality_unknown")]
    return out.select("case_id", "reader", F.coalesce("n", F.lit(0)).cast("long").alias("report_count"), *counts, *texts)


def counters(reports: DataFrame) -> DataFrame:
    """Reports by model, by source and by tier in one pass."""
    sets = reports.groupingSets([["model"], ["source"], ["evidence_tier"]], "model", "source", "evidence_tier")
    rows = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping("model").alias("gm"), F.grouping("source").alias("gs"))
    kind = F.when(F.col("gm") == 0, "model").when(F.col("gs") == 0, "source").otherwise("evidence_tier")
    return rows.select(kind.alias("kind"), F.coalesce("model", "source", "evidence_tier").alias("value"), "n")


def warning_text(reports: DataFrame) -> DataFrame:
    """For each model its warnings as ``name:count`` in the order of names."""
    counted = reports.select("model", F.explode("warnings").alias("w")).groupBy("model", "w").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("w", "n")))
    return counted.groupBy("model").agg(F.array_join(F.transform(listed, lambda s: F.concat(s["w"], F.lit(":"), s["n"].cast("string"))), ";").alias("warnings"))


def truncation_rollup(rows: DataFrame, key: str, flag: Column) -> DataFrame:
    """Rows and flagged rows for each key, and over all under ``total``."""
    out = rows.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"), F.grouping(key).alias("g"))
    return out.select(F.when(F.col("g") == 1, "total").otherwise(F.col(key)).alias(key), "n", "flagged")


def manifest_counts(cases: DataFrame, columns: list[str], present: dict[str, Column]) -> DataFrame:
    """kind, value, n and for each named condition how many cases meet it: by each column, and over all cases, in one pass."""
    sets = cases.groupingSets([*([c] for c in columns), []], *columns)
    out = sets.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(name) for name, c in present.items()), *(F.grouping(c).alias(f"__{c}") for c in columns))
    kind = F.coalesce(*(F.when(F.col(f"__{c}") == 0, c) for c in columns), F.lit("all"))
    return out.select(kind.alias("kind"), F.coalesce(*columns, F.lit("all")).alias("value"), "n", *present)


def max_merged(*counters: DataFrame) -> DataFrame:
    """Counters (key, n) merged by their largest count, not their sum."""
    out = counters[0]
    for more in counters[1:]:
        out = out.unionByName(more)
    return out.groupBy("key").agg(F.max("n").alias("n"))


def denominators(cases: DataFrame, succeeded: DataFrame, keys: list[str]) -> DataFrame:
    """Source, success and failure counts of each group and the success rate; ``succeeded`` has the cases with a result, once or more."""
    ok = succeeded.groupBy("case_id").agg(F.count(F.lit(1)).alias("__ok"))
    out = cases.join(ok, "case_id", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("source_count"), F.count("__ok").alias("success_count"))
    rate = half_up(F.col("success_count") / F.greatest("source_count", F.lit(1)), 4)
    return out.withColumn("failure_count", F.col("source_count") - F.col("success_count")).withColumn("success_rate", rate)


def generation_summary(reports: DataFrame, keys: list[str], text: str, chars: str) -> DataFrame:
    """Reports of each group: all, empty, distinct ones and their share, and their lengths."""
    shown = F.nullif(F.trim(text), F.lit(""))
    out = reports.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(shown.isNull()).alias("empty"), F.countDistinct(shown).alias("unique_reports"),
        F.min(chars).alias("shortest"), F.max(chars).alias("longest"), half_up(F.avg(chars), 4).alias("mean_chars"),
    )
    return out.withColumn("unique_rate", half_up(F.col("unique_reports") / F.greatest("n", F.lit(1))))


#: Sources of reports by the kind of route that made them.
ROUTES = {
    "artifact": ("artifact", "artifact_reuse", "cached_artifact"), "fallback": ("fallback", "cloud_fallback", "local_vlm_fallback"), "mock": ("mock", "mock_fallback"),
}


def route_counts(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Reports of each group by kind of route: artifact, fallback, mock, and fresh for all other sources; and cases with a report."""
    source = F.lower(F.trim("source"))
    known = [F.count_if(source.isin(*names)).alias(kind) for kind, names in ROUTES.items()]
    fresh = F.count_if(~F.coalesce(source.isin(*(n for names in ROUTES.values() for n in names)), F.lit(False))).alias("fresh")
    return reports.groupBy(*keys).agg(F.count(F.lit(1)).alias("routes"), *known, fresh, F.countDistinct("case_id").alias("cases"))


def reader_aggregate(cases: DataFrame, reports: DataFrame) -> DataFrame:
    """For each reader its cases (sorted), their number, its reports, and for each model (by name) its reports and their mean score.

    ``reports`` has case_id, model and score. Reports are reduced by case and model before they meet the readers.
    """
    small = reports.groupBy("case_id", "model").agg(F.count("score").alias("n"), F.sum("score").alias("s"))
    joined = cases.select("case_id", "reader").join(small, "case_id", "left")
    models = joined.where("model IS NOT NULL").groupBy("reader", "model").agg(F.sum("n").alias("n"), half_up(F.sum("s") / F.sum("n")).alias("mean"))
    listed = models.groupBy("reader").agg(F.sum("n").alias("report_count"), F.array_sort(F.collect_list(F.struct("model", "n", "mean"))).alias("models"))
    own = cases.groupBy("reader").agg(F.count(F.lit(1)).alias("case_count"), F.array_sort(F.collect_list("case_id")).alias("cases"))
    return own.join(listed, "reader", "left")
