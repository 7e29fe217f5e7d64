"""Reuse of earlier results: a memo table keyed by the digest of the input, and artifacts that still belong to their inputs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMO = "input_sha256 string, output string, output_sha256 string, made_at timestamp, stage string"


def memo(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """The stored results of a stage, one for each input (the first made, then the smallest digest); empty if there are none."""
    try:
        rows = spark.read.schema(MEMO).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MEMO).drop("stage")
    first = F.min_by(F.struct("output", "output_sha256"), F.struct("made_at", "output_sha256"))
    return rows.where(F.col("stage") == stage).groupBy("input_sha256").agg(first.alias("r")).select("input_sha256", "r.*")


def get_or_compute(spark: SparkSession, path: str, stage: str, inputs: DataFrame, producer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results, counts): inputs (id, input) with their output, and one row of hits, misses and writes.

    Only inputs whose digest is not stored are given to ``producer`` (input_sha256, input -> input_sha256, output), each distinct
    input once. Its results are appended to the memo table under ``path``, a folder that all executors share, and read again:
    after a failure, finished results are found. A stored output that no longer has its digest stops the job; an input for which
    the producer gave nothing has a null output.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", stage):
        raise ValueError(f"not a stage name: {stage!r}")
    keyed = inputs.withColumn("input_sha256", F.sha2("input", 256))
    before = memo(spark, path, stage)
    wanted = keyed.select("input_sha256", "input").dropDuplicates(["input_sha256"])
    missing = wanted.join(before.select("input_sha256"), "input_sha256", "left_anti")
    made = producer(missing).where(F.col("output").isNotNull())
    n, known = wanted.count(), before.join(wanted, "input_sha256", "left_semi").count()
    rows = made.select("input_sha256", "output", F.sha2("output", 256).alias("output_sha256"), F.current_timestamp().alias("made_at"), F.lit(stage).alias("stage"))
    if n > known:
        rows.write.mode("append").partitionBy("stage").parquet(path)
    after = memo(spark, path, stage)
    writes = after.join(wanted, "input_sha256", "left_semi").count() - known
    whole = F.when(F.sha2("output", 256) == F.col("output_sha256"), F.col("output")).otherwise(F.raise_error(F.concat(F.lit("stored output does not have its digest: "), "input_sha256")))
    found = keyed.join(after.withColumn("__found", F.lit(True)), "input_sha256", "left")
    results = found.select(*inputs.columns, "input_sha256", F.when(F.col("__found"), whole).alias("output"))
    return results, spark.createDataFrame([(known, n - known, writes)], "hits long, misses long, writes long")


def reusable(wanted: DataFrame, artifacts: DataFrame, key: str, equal: list[str]) -> DataFrame:
    """For each wanted row what to do: ``compute`` without an artifact, ``reuse`` one that succeeded and has the same values in
    all columns of ``equal``, else ``error`` with the names of what differs (``status`` first). A mismatch is never recomputed
    silently. At most one artifact for a key; two nulls are equal."""
    old = artifacts.select(key, F.struct("status", *equal).alias("__old"))
    out = wanted.join(old, key, "left")
    differs = [F.when(~F.coalesce(F.col("__old.status") == "succeeded", F.lit(False)), "status")]
    differs += [F.when(~F.col(c).eqNullSafe(F.col(f"__old.{c}")), c) for c in equal]
    out = out.withColumn("mismatch", F.when(F.col("__old").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*differs))))
    decision = F.when(F.col("__old").isNull(), "compute").when(F.size("mismatch") == 0, "reuse").otherwise("error")
    return out.withColumn("decision", decision).drop("__old")


def artifact_reports(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """Each case (case_id) with the report of its first artifact row (pos, case_id, report), and a warning.

    Rows without a case are only used if the table has a single row; else they make the cases that no earlier row names ambiguous.
    """
    known, bare = rows.where(F.coalesce("case_id", F.lit("")) != ""), F.coalesce("case_id", F.lit("")) == ""
    first = known.groupBy("case_id").agg(F.min("pos").alias("pos"), F.min_by("report", "pos").alias("report"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(bare, F.col("pos"))).alias("bare_pos"), F.min(F.when(bare, F.col("report"))).alias("bare_report"))
    out = cases.join(first, "case_id", "left").join(F.broadcast(whole))
    legacy = F.col("bare_pos").isNotNull() & (F.col("pos").isNull() | (F.col("bare_pos") < F.col("pos")))
    warning = (
        F.when(F.col("n") == 0, "artifact_case_not_found").when(legacy & (F.col("n") > 1), "artifact_case_id_missing_for_multi_case_artifact")
        .when(F.col("pos").isNull() & ~legacy, "artifact_case_not_found").otherwise("artifact_reuse_not_fresh_inference")
    )
    out = out.withColumn("warning", warning)
    report = F.when(F.col("warning") == "artifact_reuse_not_fresh_inference", F.when(legacy, F.col("bare_report")).otherwise(F.col("report")))
    return out.select(*cases.columns, F.coalesce(report, F.lit("")).alias("report"), "warning")
