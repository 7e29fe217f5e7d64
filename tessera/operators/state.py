"""Run state machine and registry over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The states a run may go to from each state; null stands for a run not yet seen.
ALLOWED = {None: ("queued",), "queued": ("running", "cancelled"), "running": ("succeeded", "failed", "cancelled"), "failed": ("queued",), "cancelled": ("queued",)}


def legal(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for state, to in ALLOWED.items():
        here = before.isNull() if state is None else F.coalesce(before == state, F.lit(False))
        out = out | (here & after.isin(*to))
    return out


def transitions(events: DataFrame, key: str, at: list[str], state: str) -> DataFrame:
    """Each event with the state before it and whether the step is legal."""
    line = Window.partitionBy(key).orderBy(*at)
    seen = events.withColumn("before", F.lag(state).over(line))
    return seen.withColumn("legal", legal(F.col("before"), F.col(state)))


def latest(events: DataFrame, key: str, at: list[str]) -> DataFrame:
    """The last event of each key, by a combinable aggregate."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("__last")).select(key, *(F.col(f"__last.{c}").alias(c) for c in rest))


def latest_output(events: DataFrame, key: str, at: list[str], output: str) -> DataFrame:
    """The last event of each key whose output is not blank; a key with blank outputs only has none."""
    return latest(events.where(F.trim(F.coalesce(output, F.lit(""))) != ""), key, at)
