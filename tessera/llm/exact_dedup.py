"""Exact dedup by a content sort, with DataFrame functions only (operator 9).

Sampled splitters range-partition the normalised texts, an external sort makes equal texts neighbours, and a window over
the sorted rows compares neighbours in full. The range key is bounded (a prefix, a digest, a salt), so the driver's sample
of keys stays small however long the texts are. Groups with more than a quarter of an average partition are found first by
a count that is combined before its shuffle; there are at most four of them for each partition, so they are broadcast, and
their rows are salted over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE, partitions, table

PREFIX = 32
SALTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def _sorted_groups(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """``docs`` dealt and sorted by content, with columns ``__*``; ``whole`` keeps all columns, else only id and digest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(c).alias(f"__own_{i}") for i, c in enumerate(docs.columns)] if whole else []
    rows = docs.select(F.col(id_col).alias("__id"), F.char_length(text).alias("__chars"), normalised(F.col(text_col)).alias("__norm"), *own)
    rows = rows.withColumns({"__sha": F.sha2("__norm", 256), "__prefix": F.substring("__norm", 1, PREFIX)})
    if whole:  # the original texts go through the shuffle, and are normalised again behind it
        rows = rows.drop("__norm")
    n = partitions(docs.sparkSession)
    best = F.min(F.struct((-F.col("__chars")).alias("c"), F.col("__id").isNull().alias("n"), F.col("__id").alias("i")))
    hot = (
        rows.groupBy("__sha")
        .agg(F.count(F.lit(1)).alias("__hot_size"), best.alias("__best"))
        .where(F.col("__hot_size") > max(64.0, docs.count() / (4 * n)))
        .select("__sha", "__hot_size", F.col("__best.i").alias("__hot_keep"))
    )
    salt = F.when(F.col("__hot_size").isNull(), 0).otherwise(F.pmod(F.xxhash64("__id"), F.lit(SALTS)))
    key = ["__prefix", "__sha", "__salt"]
    dealt = rows.join(F.broadcast(hot), "__sha", "left").withColumn("__salt", salt).repartitionByRange(n, *key)
    if whole:
        dealt = dealt.withColumn("__norm", normalised(F.col(f"__own_{docs.columns.index(text_col)}")))
    order = Window.partitionBy(*key, "__norm").orderBy(F.col("__chars").desc(), F.col("__id").asc_nulls_last())
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = dealt.select("*", F.row_number().over(order).alias("__rank"), F.first("__id").over(all_).alias("__first"), F.count(F.lit(1)).over(all_).alias("__size"))
    keep = F.when(F.col("__hot_size").isNotNull(), F.col("__hot_keep")).otherwise(F.col("__first"))
    seen = seen.withColumn("__keep", keep)
    return seen.withColumn("__kept", (F.col("__rank") == 1) & F.col("__id").eqNullSafe(F.col("__keep")))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when the same after deleting ASCII white space; a null text counts as empty. The row with the most code
    points in its original text stays, then the smallest id, nulls last; of rows that tie in both, one is ``kept``.
    An empty table gives an empty result. Columns not named are ignored, so clashing names do no harm.
    """
    return _sorted_groups(docs, id_col, text_col, False).select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.coalesce("__hot_size", "__size").alias("group_size"),
        F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all columns and no others."""
    kept = _sorted_groups(docs, id_col, text_col, True).where("__kept")
    return kept.select(*(F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
"""
