"""Merging batches, coverage, plans and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up


def merge_batches(batches: list[DataFrame]) -> DataFrame:
    """All rows of all batches, whose columns may differ, with the batch they are from (``batch_no``, from 0) and ``copies``, the rows of the case in all."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (b.withColumn("batch_no", F.lit(i)) for i, b in enumerate(batches)))
    counts = merged.groupBy("case_id").agg(F.count(F.lit(1)).alias("copies"))
    return merged.join(counts, "case_id")


def missing_and_extra(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A row for each key that only one side has."""
    a, b = declared.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("extra")))


def plan_problems(cases: DataFrame, candidates: list[str], repeats: int, done: DataFrame) -> DataFrame:
    """case_id, candidate, repeat and problem where results are not exactly cases x candidates x repeats: missing, extra or duplicate.

    Candidates and repeats are configuration: each case is expanded by an array, results are counted first.
    """
    keys = ["case_id", "candidate", "repeat"]
    wanted = cases.select("case_id").distinct().select("case_id", F.explode(F.array(*map(F.lit, candidates))).alias("candidate"))
    wanted = wanted.select("case_id", "candidate", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"), F.lit(True).alias("__w"))
    counted = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    problem = F.when(F.col("__w").isNull(), "extra").when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "duplicate")
    return wanted.join(counted, keys, "full").select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def compatible(cases: DataFrame, models: DataFrame, open_to_all: Column) -> DataFrame:
    """case_id and model of each model that supports the case's modality, or any modality where ``open_to_all`` holds for the case.

    ``models`` is a small dimension (model, supported); ``supported`` is a modality or ``unknown`` for any.
    """
    keyed = cases.withColumn("__for", F.explode(F.array_compact(F.array(F.col("modality"), F.when(open_to_all, "unknown")))))
    return keyed.join(F.broadcast(models.withColumnRenamed("supported", "__for")), "__for").select("case_id", "model")


def plan_coverage(cases: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """Cases of each group, those with a route, routes, and the covered share."""
    by_case = routes.groupBy("case_id").agg(F.count(F.lit(1)).alias("__r"))
    out = cases.join(by_case, "case_id", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count("__r").alias("covered"), F.coalesce(F.sum("__r"), F.lit(0)).alias("routes"))
    return out.withColumn("coverage", half_up(F.col("covered") / F.greatest("cases", F.lit(1))))


def unambiguous(rows: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """hash and id of the hashes that name one id only."""
    out = rows.groupBy(hash_col).agg(F.min(id_col).alias(id_col), F.max(id_col).alias("__max"))
    return out.where(F.col(id_col) == F.col("__max")).select(hash_col, id_col)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each key and rule that it breaks; a rule that gives null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def gate_matrix(rows: DataFrame, keys: list[str], gates: dict[str, Column]) -> DataFrame:
    """Gates passed, failed and in all for each group; validated only if all its gates passed for all its rows."""
    each = rows.groupBy(*keys).agg(*(F.bool_and(F.coalesce(g, F.lit(False))).alias(f"g_{n}") for n, g in gates.items()))
    passed = sum((F.col(f"g_{n}").cast("int") for n in gates), F.lit(0))
    return each.select(*keys, passed.alias("passed"), (len(gates) - passed).alias("failed"), F.lit(len(gates)).alias("total"), F.when(passed == len(gates), "validated").otherwise("pilot").alias("status"))
