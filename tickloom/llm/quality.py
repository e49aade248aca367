"""Quality of documents by hierarchical empirical Bayes.

A logistic model turns the shape of a text into evidence. Every site then gets a
Beta posterior of its share of good documents: the host is shrunk toward the
global share, the path toward its host, each with a strength estimated from the
spread between sites (method of moments), so that sparse sites stay close to
their parent. The document's evidence is combined with the posterior of its path
in place of the global share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common

MOST_LABELLED = 20_000
REJECT_BELOW = 0.5
SYMBOLS = b"|#$%&*!@=_<>{}"
FEATURES = 15


def features(text: bytes) -> np.ndarray:
    """Shape of a whole text; all zero for a text without words."""
    out = np.zeros(FEATURES)
    found = text.split()
    if not found:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total, number = len(text), len(found)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    symbols = sum(int(counts[c]) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x]
    repeats = sum(map(bytes.__eq__, found, found[1:]))
    out[:] = (
        np.log1p(number),
        letters / total,
        counts[48:58].sum() / total,
        counts[65:91].sum() / total,
        np.sqrt(symbols / total),
        np.sqrt(counts[124] / number),
        np.sqrt((counts[46] + counts[44]) / number),
        np.sqrt(repeats / number),
        len(set(found)) / number,
        np.log(total / number),
        np.sqrt(sum(1 for x in found if len(x) <= 3) / number),
        1 - len(set(lines)) / len(lines),
        np.log1p(number / len(lines)),
        max(0.0, np.log1p(repeats) - 1),
        np.log1p(symbols),
    )
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), common.lists(np.stack(found) if found else np.empty((0, FEATURES)))],
            names=["id", "x"],
        )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights with the intercept first, by Newton steps on a ridge penalty."""
    x = np.hstack([np.ones((len(x), 1)), x])
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + penalty * weights
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


class Evidence:
    """Log-odds of good quality of a text, with squares and products of its features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> None:
        self.mean, self.scale, self.weights = mean, scale, weights

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        first, second = np.triu_indices(x.shape[1])
        return np.hstack([x, np.clip(x[:, first] * x[:, second], -20, 20)])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Evidence:
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            size = FEATURES + FEATURES * (FEATURES + 1) // 2
            return cls(np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.log(share / (1 - share)), np.zeros(size)])
        mean, scale = x.mean(0), x.std(0) + 1e-6
        return cls(mean, scale, fit_logistic(cls.expand(np.clip((x - mean) / scale, -6, 6)), y))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.clip((np.stack([features(t) for t in texts]) - self.mean) / self.scale, -6, 6)
        return np.clip(self.weights[0] + self.expand(x) @ self.weights[1:], -15, 15)


RESULTS = ("quality_evidence", "host_posterior", "path_posterior", "quality_score", "quality_kept")


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = MOST_LABELLED) -> Evidence:
    """The evidence model from about `most` labelled documents, chosen by a hash of their id.

    The bound covers what reaches the driver: one short vector per document.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.avg("quality").alias("quality")
    )
    chosen = marked.where(common.one_of(F.xxhash64("doc_id"), most, marked.count()))
    rows = docs.select(F.col(id_col).alias("id"), common.text_bytes(F.col(text_col)).alias("text"))
    # At most about `most` ids of a few bytes each.
    rows = rows.join(F.broadcast(chosen.select(F.col("doc_id").alias("id"))), "id", "left_semi")
    vectors = rows.select("id", "text").mapInArrow(_vectors, f"id {dict(rows.dtypes)['id']}, x array<double>")
    found = vectors.join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), "id").select("x", "quality").toPandas()
    x = np.stack(found["x"]) if len(found) else np.empty((0, FEATURES))
    return Evidence.fit(x, (found["quality"].to_numpy() >= 0.5).astype(float))


def evidence_udf(model: Evidence):
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model(texts.tolist()))

    return F.pandas_udf(score, "double")


def host(site: Column) -> Column:
    """Host of an address, or the name itself; empty for null."""
    return F.lower(F.regexp_extract(F.coalesce(site, F.lit("")), r"^(?:[A-Za-z][\w+.-]*://)?([^/?#]*)", 1))


def path(site: Column) -> Column:
    """First path segment of an address; empty if there is none."""
    return F.regexp_extract(F.coalesce(site, F.lit("")), r"^(?:[A-Za-z][\w+.-]*://)?[^/?#]*/([^/?#]*)", 1)


def _strength(groups: DataFrame, rate: Column) -> Column:
    """Prior strength as an aggregate over sites with n documents, g good and the parent's `rate`.

    Moments of a Beta-binomial: the spread of the sites' shares beyond what
    sampling gives is their intra-site correlation r; the strength is (1 - r) / r.
    """
    spread = F.sum(F.pow(F.col("g") - F.col("n") * rate, 2) / F.col("n") - rate * (1 - rate))
    extra = F.sum((F.col("n") - 1) * rate * (1 - rate))
    r = F.greatest(F.lit(1e-4), F.least(F.lit(0.99), F.coalesce(spread / F.nullif(extra, F.lit(0.0)), F.lit(0.0))))
    return (1 - r) / r


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_posterior, path_posterior) from `scored(host, path, p)`, and the global share."""
    paths = common.stored(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("g")), "quality-sites"
    )
    total = paths.agg(F.sum("n").alias("n"), F.sum("g").alias("g")).first()
    prior = (total["g"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    strength = hosts.agg(_strength(hosts, F.lit(prior)).alias("s")).first()["s"] or 1e4
    hosts = hosts.select("host", ((F.col("g") + strength * prior) / (F.col("n") + strength)).alias("host_posterior"))
    both = paths.join(hosts, "host")
    strength = both.agg(_strength(both, F.col("host_posterior")).alias("s")).first()["s"] or 1e4
    both = both.select(
        "host",
        "path",
        "host_posterior",
        ((F.col("g") + strength * F.col("host_posterior")) / (F.col("n") + strength)).alias("path_posterior"),
    )
    return common.stored(both, "quality-posteriors"), prior


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """`docs` with quality_evidence, host_posterior, path_posterior, quality_score and quality_kept.

    The score is the probability of good quality, a document below
    `REJECT_BELOW` is rejected. `labels` has (doc_id, quality 0/1). The model
    sees only the text, never id, language or label.

    A null text counts as empty; empty texts get the evidence of an all-zero
    shape. Rows without a site share the site ''. Rows without an id are scored
    too. Without usable labels every text has the same evidence. All columns of
    `docs` are kept; columns named like the five results are replaced.
    """
    common.prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, most_labelled)
    evidence = evidence_udf(model)
    text, site = common.text_bytes(F.col(text_col)), F.col(site_col)
    probability = 1 / (1 + F.exp(-F.col("evidence")))
    counted = docs.select(host(site).alias("host"), path(site).alias("path"), evidence(text).alias("evidence"))
    posteriors, prior = site_posteriors(counted.select("host", "path", probability.alias("p")))
    own_host, own_path, *names = common.unused(docs, "_host", "_path", *(f"_site_{c}" for c in posteriors.columns))
    posteriors = posteriors.toDF(*names)
    site_host, site_path, of_host, of_path = map(F.col, names)
    base = docs.drop(*RESULTS)
    logit = lambda p: F.log(p / (1 - p))
    joined = (
        base.withColumns({own_host: host(site), own_path: path(site)})
        .join(posteriors, (F.col(own_host) == site_host) & (F.col(own_path) == site_path), "left")
        .withColumn("quality_evidence", evidence(text))
    )
    held = F.least(F.greatest(of_path, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = F.col("quality_evidence") - float(np.log(prior / (1 - prior))) + logit(held)
    return (
        joined.withColumn("quality_score", 1 / (1 + F.exp(-posterior)))
        .withColumn("quality_kept", F.col("quality_score") >= REJECT_BELOW)
        .withColumns({"host_posterior": of_host, "path_posterior": of_path})
        .drop(own_host, own_path, *names)
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with their own columns."""
    own = dict(zip(RESULTS, common.unused(docs, *RESULTS), strict=True))
    kept = score(docs.withColumnsRenamed(own), labels).where("quality_kept").drop(*RESULTS)
    return kept.withColumnsRenamed({new: old for old, new in own.items()}).select(docs.columns)
