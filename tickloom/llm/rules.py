"""Quality rules and a hashed n-gram likelihood ratio, with DataFrame functions only.

Word and word-pair hashes fall into a fixed number of buckets. Two multinomials
over the buckets are counted, one over trusted texts and one over all texts; the
weight of a bucket is the logarithm of their ratio, as a whole number, so that a
document's sum does not depend on any order. A document's score is its sum by
its number of n-grams, and a fixed threshold decides on every document alike.

Counting shuffles one row per bucket and task; scoring is one pass without a
shuffle, as the weights are a constant of fixed size. A document's cost is that
of sorting its own windows of three words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common

BUCKETS = 1 << 16
TRUSTED_DOCS = 20_000
SMOOTHING = 10.0  # added to the number of trusted n-grams that a bucket has, and should have
SCALE = 1 << 16  # weights are whole multiples of 1 / SCALE
THRESHOLD = -0.15

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
PLACE = (1 << 31) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def _buckets(words: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbouring words; the pair after the last word is null."""

    def bucket(text: Column) -> Column:
        return (F.crc32(text.cast("binary")) % buckets).cast("int")

    following = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(words, following, lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(words, bucket), pairs)


def _following(place: Column) -> list[Column]:
    return [F.get("words", place + k) for k in range(1, WINDOW)]


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", most: int = TRUSTED_DOCS) -> DataFrame:
    """Ids that every label calls good, at most `most` of them, chosen by a hash of the id."""
    return (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("trusted_id"))
        .agg(F.min(good_col).alias("good"))
        .where("good = 1")
        .select("trusted_id")
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(most)
    )


def bucket_weights(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
) -> list[int]:
    """log(trusted / raw) of every bucket times SCALE; zeros where nothing is trusted.

    `smoothing` draws a bucket with few n-grams towards 0, so that what a text
    adds to the raw counts alone does not speak against it.

    `trusted(trusted_id)` is of bounded size and goes to every task. Only one
    row per bucket, whatever the size of the table, comes to the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words"))
    flagged = rows.join(F.broadcast(trusted), F.col("id") == F.col("trusted_id"), "left").select(
        F.col("trusted_id").isNotNull().cast("long").alias("trusted"), _buckets(F.col("words"), buckets).alias("grams")
    )
    counted = (
        flagged.select("trusted", F.explode_outer("grams").alias("bucket"))
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("trusted"))
        .collect()
    )
    raw, good = [0] * buckets, [0] * buckets
    for row in counted:
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["trusted"]
    all_raw, all_good = sum(raw), sum(good)
    if not all_good:
        return [0] * buckets
    share = all_good / all_raw
    return [
        round(SCALE * math.log((g + smoothing) / (r * share + smoothing))) for g, r in zip(good, raw, strict=True)
    ]


def measured(docs: DataFrame, text_col: str = "text", weights: list[int] | None = None) -> DataFrame:
    """Replaces the text by its counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr_sum, n_grams.

    Other columns stay. `llr_sum` is in units of 1 / SCALE, and 0 without weights.
    """
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    split = docs.select(*others, _words(text).alias("words"), full.alias("lines"))
    # A window as one number, its hash above its place: equal windows stand together when sorted.
    hashes = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.shiftleft(F.xxhash64(w, *_following(i)).bitwiseAND(F.lit(PLACE)), 31).bitwiseOR(i.cast("long")),
    )
    glued = F.array_join("words", "")
    grams = _buckets(F.col("words"), len(weights)) if weights else F.array().cast("array<int>")
    found = split.select(
        *others,
        F.size("words").cast("long").alias("n_words"),
        F.length(glued).cast("long").alias("word_chars"),
        (F.length(glued) - F.length(F.regexp_replace(glued, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words",
        F.sort_array(hashes).alias("windows"),
        grams.alias("grams"),
    )
    same = lambda x, y: F.shiftright(x, 31) == F.shiftright(y, 31)
    alike = F.filter("windows", lambda x, i: same(x, F.get("windows", i - 1)) | same(x, F.get("windows", i + 1)))
    # The few windows of equal hash are compared as they are.
    texts = F.transform(
        F.transform(alike, lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int")),
        lambda at: F.struct(F.concat_ws(" ", F.get("words", at), *_following(at)).alias("gram"), at.alias("at")),
    )
    table = F.split(F.lit(" ".join(map(str, weights))), " ").cast("array<int>") if weights else None
    score = (
        F.aggregate("grams", F.lit(0).cast("long"), lambda s, b: s + F.coalesce(F.get(table, b), F.lit(0)))
        if weights
        else F.lit(0).cast("long")
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    found = found.select(*others, *counts, F.sort_array(texts).alias("alike"), score.alias("llr_sum"))
    twice = F.filter(
        "alike", lambda x, i: (x["gram"] == F.get("alike", i - 1)["gram"]) | (x["gram"] == F.get("alike", i + 1)["gram"])
    )
    places = F.sort_array(F.transform(twice, lambda x: x["at"]))
    placed = found.select(*others, *counts, places.alias("places"), "llr_sum")
    # Each window covers three words, or those up to the next such window.
    covered = F.aggregate(
        F.transform("places", lambda at, i: F.least(F.coalesce(F.get("places", i + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    return placed.select(
        *others,
        *counts,
        covered.alias("n_repeat_words"),
        "llr_sum",
        F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("long").alias("n_grams"),
    )


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    good_col: str = "quality",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    trusted_docs: int = TRUSTED_DOCS,
) -> DataFrame:
    """(id, counts, llr_sum, n_grams, base_failed, kept) of every row.

    `base_failed` has fewer than 50 words or more than half of them in repeated
    windows; other rows are kept if `llr_sum` is at least `threshold` * SCALE for
    each n-gram. Trusted are texts whose labels are all good; the first
    `trusted_docs` ids by hash are used. Raw counts are over all texts.

    A null text has no words. A null id is judged like others but is never
    trusted; rows that repeat an id are judged one by one. Null labels count for
    nothing; without a trusted text every ratio is 1. Extra columns are not looked
    at. A text is held by one task, with about twenty times its size for its
    windows. An empty table gives no rows.
    """
    weights = bucket_weights(docs, trusted_ids(labels, id_col, good_col, trusted_docs), id_col, text_col, buckets)
    rows = measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", weights)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    likely = F.col("llr_sum") >= F.ceil(F.lit(threshold) * SCALE).cast("long") * F.col("n_grams")
    return rows.select(
        F.col("id").alias(id_col),
        *[c for c in rows.columns if c != "id"],
        failed.alias("base_failed"),
        (~failed & likely).alias("kept"),
    )
