"""The registered queries on the small tables, the pipeline against brute force."""

import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from oracle_check import connect, difference
from tickloom.llm import quality, toxicity
from tickloom.llm.queries import QUERIES
from tickloom.llm.sql import ORACLE_SQL


def test_names():
    assert set(QUERIES) | {"pipeline"} <= set(spark_entry.queries())
    assert set(ORACLE_SQL) <= set(spark_entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", ["op2_capfilter", "op5_language", "op8_quality"])
def test_one_row_each(spark, sf_dir, name):
    source = "embeddings" if name == "op2_capfilter" else "documents"
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_pipeline(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = {r["doc_id"] for r in quality.score(docs, labels).where("quality_kept").collect()}
    after = corpus_pipeline.good_quality(spark, docs, sf_dir)
    assert after.columns == docs.columns and {r["doc_id"] for r in after.collect()} == good

    clean = {r["doc_id"] for r in toxicity.score(after, labels).where("predicted = 0").collect()}
    after = corpus_pipeline.not_toxic(spark, after, sf_dir)
    assert {r["doc_id"] for r in after.collect()} == clean

    def sets(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    kept, held = set(), {i: sets(texts[i]) for i in sorted(clean)}
    group = {}
    for i in held:
        group[i] = i
        for j in list(group):
            if j < i:
                both = len(held[i] & held[j])
                if both and 100 * both >= 80 * (len(held[i]) + len(held[j]) - both):
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = {k: new if g == old else g for k, g in group.items()}
    kept = {i for i, g in group.items() if i == g}
    after = corpus_pipeline.one_of_each(spark, after, sf_dir)
    assert after.columns == docs.columns and {r["doc_id"] for r in after.collect()} == kept

    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in pieces.collect()} == kept
