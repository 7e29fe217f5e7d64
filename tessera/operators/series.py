"""Choice of an image series for each case from a table of headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a series of a brain MRI scores by the words in its description.
BRAIN_SERIES = {"flair": 100, "t2": 20}


def series(headers: DataFrame) -> DataFrame:
    """One row for each series: headers (case_id, path, instance, series_uid, rows, columns, description, protocol, sequence).

    The key is ``uid:RxC``; n the number of images; ``described`` holds the words of the first image (by instance, then path).
    """
    size = F.concat(F.coalesce(F.col("rows").cast("string"), F.lit("")), F.lit("x"), F.coalesce(F.col("columns").cast("string"), F.lit("")))
    key = F.concat_ws(":", F.coalesce("series_uid", F.lit("unknown")), size)
    words = F.lower(F.concat_ws(" ", "description", "protocol", "sequence"))
    first = F.struct(F.coalesce("instance", F.lit(1 << 30)), "path")
    return headers.groupBy("case_id", key.alias("series_key")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.min_by(words, first).alias("described"))


def chosen_series(headers: DataFrame, cases: DataFrame) -> DataFrame:
    """One series for each case (case_id, modality, body_part) that has images.

    Brain MRI prefers FLAIR, then T2; otherwise, and among equals, the series with most images, then the first path.
    """
    brain = (F.col("modality") == "mri") & (F.lower("body_part") == "brain")
    kind = F.lit("largest")
    for word in reversed(BRAIN_SERIES):
        kind = F.when(brain & F.col("described").contains(word), word).otherwise(kind)
    rank = F.lit(0)
    for word, score in BRAIN_SERIES.items():
        rank = F.when(F.col("type") == word, score).otherwise(rank)
    rows = series(headers).join(cases.select("case_id", "modality", "body_part"), "case_id").withColumn("type", F.coalesce(kind, F.lit("largest")))
    best = rows.groupBy("case_id").agg(F.min_by(F.struct("series_key", "n", "type"), F.struct((-rank).alias("a"), (-F.col("n")).alias("b"), "first_path")).alias("s"))
    reason = F.when(F.col("s.type") == "largest", "largest_series").otherwise(F.concat(F.lit("brain_mri_"), "s.type", F.lit("_preferred")))
    return best.select("case_id", "s.series_key", "s.n", F.col("s.type").alias("series_type"), reason.alias("reason"))
