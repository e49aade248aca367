"""The corpus pipeline: quality, toxicity, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; all but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import common, minhash, packing, quality, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SIMILAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every near-duplicate group.

    Documents without an id stay. Rows that repeat an id with the same text are
    copies of each other; one stays.
    """
    return minhash.keep_one(docs, percent=SIMILAR_PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each),
    ("packing", packed),
]

# Classifiers and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir).select(docs.columns), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
