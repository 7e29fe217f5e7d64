"""Sinks: JSON lines, CSV with a fixed heading, an append-only registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a key's name that mark a secret.
SECRET = ("key", "token", "secret", "password", "pat")


def json_lines(rows: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """Rows as JSON lines, in range-partitioned order: the files in name order hold the rows in order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).json(path)


def csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a heading; an empty table keeps its columns, one without columns has the heading ``empty``."""
    rows = rows if rows.columns else rows.select(F.lit(None).cast("string").alias("empty")).limit(0)
    rows.write.mode(mode).option("header", True).csv(path)


def redacted(entries: Column) -> Column:
    """A string map whose secret values are masked."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET)), F.lit("***")).otherwise(v))


def append_registry(entries: DataFrame, path: str) -> None:
    """Adds entries to the registry; its latest state is derived by ``operators.state.latest``."""
    entries.withColumn("config", redacted(F.col("config"))).write.mode("append").parquet(path)
