"""The driver's tables as cases, reports, metrics, hazards and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.eligibility import evidence_tier


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "ct").when(F.col("o_orderstatus") == "O", "cxr").otherwise("mri")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.concat(F.lit("reader_"), (F.col("o_custkey") % 12).cast("string")).alias("reader"),
        kind.alias("modality"), F.col("o_orderpriority").alias("body_part"), (F.col("o_orderkey") % 5).alias("batch"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated report for each line: its place, route, quality gate, warnings and metrics."""
    source = (
        F.when(F.col("l_returnflag") == "A", "artifact_reuse").when(F.col("l_returnflag") == "N", "fresh_cli")
        .when(F.col("l_linestatus") == "F", "mock_fallback").otherwise("cloud_fallback")
    )
    warnings = F.array_compact(F.array(F.when(F.col("l_discount") >= 0.08, "low_contrast"), F.when(F.col("l_discount") <= 0.01, "short_report"), F.when(F.col("l_tax") >= 0.07, "late_review")))
    quality = F.when(F.col("l_partkey") % 10 == 0, "unknown").when(F.col("l_tax") <= 0.06, "passed").otherwise("failed")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("k1"), F.col("l_partkey").alias("k2"),
        F.col("l_extendedprice").alias("k3"), F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("model"), source.alias("source"),
        quality.alias("quality"), warnings.alias("warnings"), (F.lit(1.0) + 40 * F.col("l_discount")).alias("likert_mean"),
        (F.col("l_tax") / 0.08).alias("structure_score"), (F.col("l_quantity") / 50).alias("finding_coverage"),
    )
    return rows.withColumn("evidence_tier", evidence_tier(F.col("source")))


def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") % 7).alias("error_type"), (1 + F.col("l_partkey") % 5).cast("int").alias("level"),
        (1 + F.col("l_suppkey") % 5).cast("int").alias("review_level"), (F.col("l_quantity") % 11 == 0).alias("abstain"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd lines are candidate findings, even ones reference findings of their case."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") % 2 == 1, "cand").otherwise("ref").alias("side"),
        F.concat(F.lit("obs"), (F.col("l_partkey") % 6).cast("string")).alias("observation"),
        F.when(F.col("l_suppkey") % 4 == 0, "unspecified").otherwise(F.concat(F.lit("loc"), (F.col("l_suppkey") % 4).cast("string"))).alias("location"),
        F.when(F.col("l_linenumber") % 3 == 0, "unknown").when(F.col("l_linenumber") % 3 == 1, "left").otherwise("right").alias("laterality"),
        F.when(F.col("l_returnflag") == "R", "uncertain").when(F.col("l_returnflag") == "A", "present").otherwise("absent").alias("certainty"),
        F.lit("unspecified").alias("severity"), F.col("l_quantity").alias("mm"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate").alias("finding_id"),
    )
