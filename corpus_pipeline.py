"""A corpus pipeline of five stages, each by one operator of ``tessera.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
``docs``, whatever they are; the last returns one row of token digests for each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import token_digests
from tessera.llm.common import dropped, fresh, stored, table
from tessera.llm.exact_dedup import without_copies
from tessera.llm.mixing import mixed_documents
from tessera.llm.simhash import one_of_each
from tessera.llm.toxicity import learn_from, with_scores

REJECTED = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose chance of being toxic is REJECTED or more; null and empty texts stay."""
    scorer = learn_from(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return with_scores(docs, scorer, score).where(F.col(score) < REJECTED).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of equal texts: the longest original, then the smallest doc_id."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of each group linked by a similarity of 0.8 over five words."""
    return one_of_each(docs, 5, 0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources at weights 5, 2, 1 asks for; repeated documents are repeated rows, and texts without words stay once."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes decoded from them, for each row."""
    return token_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: Fitted scores, sampled tables and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage returns is written once to the shared folder, and its input is dropped then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir))
        dropped(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
