"""A SQL front end: tables of the model and named queries as temporary views, made when a statement names them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import adapters as A

TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"cases": A.cases, "reports": A.reports, "hazards": A.hazards, "findings": A.findings}


def names_in(statement: str) -> list[str]:
    """The words of a statement outside quoted texts and comments, in lower case, each once."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|--[^\n]*|/\*.*?\*/", " ", statement, flags=re.S)
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", bare)))


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> list[str]:
    """Temporary views of the given tables and queries; names that are neither are passed over. Returns those made."""
    from tessera.plans.queries import QUERIES

    known = {**{n.lower(): f for n, f in QUERIES.items()}, **TABLES}
    made = [n for n in names if n in known]
    for n in made:
        known[n](spark, sf_dir).createOrReplaceTempView(n)
    return made


def sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """The result of a statement over the model's tables, the named queries and the session's own tables."""
    register(spark, sf_dir, names_in(statement))
    return spark.sql(statement)
