"""The operators as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    bpe,
    capfilter,
    common,
    language,
    manifest,
    minhash,
    multiindex,
    packing,
    prefixes,
    quality,
    quotes,
    recurrent,
    rules,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op2_capfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_vectors(common.table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(common.table(spark, sf_dir, "conversations"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(common.table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(common.table(spark, sf_dir, "documents"))


def op7_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return multiindex.search(vectors, vectors.where("vec_id % 20 = 0"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return quality.score(docs, labels).select(
        "doc_id", "quality_evidence", "host_posterior", "path_posterior", "quality_score", "quality_kept"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(common.table(spark, sf_dir, "documents"))


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.rebuilt_trie(common.table(spark, sf_dir, "conversations"))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.when(common.fraction(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    docs = common.table(spark, sf_dir, "documents")
    return manifest.verified(manifest.manifest(docs, tampered={"n_chars": claim}))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash,
        op2_capfilter,
        op3_packing,
        op4_quotes,
        op5_language,
        op6_bpe,
        op7_multiindex,
        op8_quality,
        op9_toxicity,
        op10_recurrent,
        op11_prefixes,
        op12_rules,
        op13_manifest,
    )
}
