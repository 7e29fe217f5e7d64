"""Transcription quality: token accuracies, model means, the best model."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.functions.numbers import finite, half_up

#: Fixed values.
NUMBERS = re.compile(r"\d+(?:\.\d+)?\s*(?:mm|cm|ml|%|毫米|厘米)?")
NEGATIONS = re.compile(r"\b(?:no|not|without)\b|否认|未见|未发现|无")


def sequence_accuracy(gold: list[str], found: list[str]) -> float:
    """1 - edits / length of the longer sequence; without gold tokens 1 if none was found, else 0."""
    if not gold:
        return float(not found)
    row = list(range(len(found) + 1))
    for i, g in enumerate(gold, 1):
        diagonal, row[0] = row[0], i
        for j, f in enumerate(found, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (g != f))
    return 1 - row[-1] / max(len(gold), len(found))


@F.pandas_udf(StructType().add("numbers", DoubleType()).add("negations", DoubleType()))
def token_accuracy(gold: pd.Series, found: pd.Series) -> pd.DataFrame:
    """Accuracies of the numbers with units and of the negations, each in the order of the text."""

    def tokens(pattern: re.Pattern, text: str | None) -> list[str]:
        return [m[0].replace(" ", "") for m in pattern.finditer(unicodedata.normalize("NFKC", text or "").lower())]

    return pd.DataFrame({name: [sequence_accuracy(tokens(p, g), tokens(p, f)) for g, f in zip(gold, found)] for name, p in (("numbers", NUMBERS), ("negations", NEGATIONS))})


def model_means(rows: DataFrame, metrics: tuple[str, ...], truncated: str) -> DataFrame:
    """Means for each model over the rows where all metrics are finite, and how many of these are cut off."""
    ok = F.lit(True)
    for m in metrics:
        ok = ok & finite(F.col(m))
    return rows.where(ok).groupBy("model").agg(F.count(F.lit(1)).alias("case_count"), *(half_up(F.avg(m)).alias(f"{m}_mean") for m in metrics), F.count_if(F.col(truncated)).alias("truncation_count"))


def winner(means: DataFrame, error: str, negations: str) -> DataFrame:
    """The model with the least error, then the fewest cut texts, then the best negations, then by name."""
    order: Column = F.struct(F.col(error), F.col("truncation_count"), -F.col(negations), F.col("model"))
    return means.agg(F.min_by("model", order).alias("primary_model"))
