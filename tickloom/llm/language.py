"""Language of texts by bit-sliced Bloom filters of character n-grams.

One table of slots serves all languages: a slot holds a bit per language, so the
AND of an n-gram's slots returns all languages that contain it at once. A text
is decided by the number of its n-grams in each language, corrected for the
filter's false positives.

An n-gram belongs to a language when it is about as frequent there as in the
language where it is most frequent; foreign lines in a text do not spread it.
The table is built by Spark as a bitwise OR per slot, so what reaches the driver
has the fixed size of the filter, whatever the corpus.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common

HELD_OUT_OF, HELD_OUT = 4, 2
SLOT_BITS = 21
HASHES = 3
ORDERS = (3, 4)
RELATIVE = 0.25  # of the rate in the language where the n-gram is most frequent
LEAST_COUNT = 3
MOST_LANGUAGES = 64
UNDETERMINED = "und"
FLUSH = 200_000


class Letters:
    """Letter test for all code points as a table."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table


def code_points(text: str) -> np.ndarray:
    """Lower-cased text with a blank at both ends and for all that is no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(Letters.get()[points], points, 32).astype(np.uint64)


def ngrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, end positions) of the n-grams that do not reach across words."""
    letter = points != 32
    found, ends = [], []
    with np.errstate(over="ignore"):
        for order in ORDERS:
            size = len(points) - order + 1
            if size <= 0:
                continue
            inner = np.ones(size, bool)
            value = np.full(size, order, np.uint64)
            for k in range(order):
                value = value * np.uint64(0x100000001B3) ^ points[k : k + size]
                if 0 < k < order - 1:
                    inner &= letter[k : k + size]
            keep = np.flatnonzero(inner)
            found.append(common.mixed(value[keep]))
            ends.append(keep + order - 1)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(ends)


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The filter's slots of every n-gram, by its 64-bit hash."""
    with np.errstate(over="ignore"):
        return [
            ((hashes * np.uint64(odd)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:HASHES]
        ]


def _rows(lang: str, seen: Counter[str]) -> pa.RecordBatch:
    tokens = list(seen)
    points = code_points(" ".join(tokens))
    lengths = np.fromiter((len(t.lower()) + 1 for t in tokens), np.int64, len(tokens))
    weights = np.repeat(np.fromiter(seen.values(), np.int64, len(tokens)), lengths)
    hashes, ends = ngrams(points)
    # An n-gram ends in its token or at the blank after it.
    weight = weights[np.clip(ends - 1, 0, len(weights) - 1)]
    grams, place = np.unique(hashes, return_inverse=True)
    counts = np.bincount(place, weight, len(grams)).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(grams), pa.string()), pa.array(common.signed(grams)), pa.array(counts)],
        names=["lang", "gram", "n"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter[str]] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[lang].update(text.split())
        for lang, counter in seen.items():
            if len(counter) > FLUSH:
                yield _rows(lang, counter)
                counter.clear()
    for lang, counter in seen.items():
        if counter:
            yield _rows(lang, counter)


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column(0).to_numpy().view(np.uint64)
        for slot in slots(hashes):
            yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column(1)], names=["slot", "mask"])


class Filter:
    """The slots' language bits, and each language's false-positive rate."""

    def __init__(self, langs: list[str], masks: np.ndarray) -> None:
        self.langs, self.masks = langs, masks
        filled = [float(np.mean((masks >> np.uint64(i)) & np.uint64(1))) for i in range(len(langs))]
        self.false = np.array(filled) ** HASHES

    def languages(self, hashes: np.ndarray) -> np.ndarray:
        """Bits of all languages that contain each n-gram."""
        found = np.full(len(hashes), 2**64 - 1, np.uint64)
        for slot in slots(hashes):
            found &= self.masks[slot]
        return found

    def decide(self, text: str) -> tuple[str, float]:
        points = code_points(text)
        if not (points != 32).any() or not self.langs:
            return UNDETERMINED, 0.0
        hashes = ngrams(points)[0]
        found = self.languages(hashes)
        shares = np.array([np.count_nonzero(found & np.uint64(1 << i)) for i in range(len(self.langs))]) / max(1, len(hashes))
        held = np.clip((shares - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
        best = int(np.argmax(held))
        total = held.sum()
        return self.langs[best], float(held[best] / total) if total > 0 else 1 / len(self.langs)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    """The filter from all texts with a language whose id is not held out."""
    common.prepare(docs.sparkSession)
    train = docs.where(
        F.col(lang_col).isNotNull()
        & F.col(text_col).isNotNull()
        & F.coalesce(common.fraction(F.col(id_col), HELD_OUT_OF) != HELD_OUT, F.lit(False))
    ).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = common.stored(
        train.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "language-grams",
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang")
    found = totals.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(r["lang"] for r in found)
    masks = np.zeros(1 << SLOT_BITS, np.uint64)
    if not langs:
        return Filter([], masks)
    known = docs.sparkSession.createDataFrame(
        [(r["lang"], langs.index(r["lang"]), float(r["total"])) for r in found], "lang string, place int, total double"
    )
    rates = (
        counts.where(F.col("n") >= LEAST_COUNT)
        .join(F.broadcast(known), "lang")
        .select("gram", "place", (F.col("n") / F.col("total")).alias("rate"))
    )
    # One entry per language at most, so the list is bounded.
    grams = rates.groupBy("gram").agg(F.collect_list(F.struct("rate", "place")).alias("held")).select(
        "gram",
        F.expr(
            "aggregate(held, 0L, (m, x) -> m | "
            f"if(x.rate >= {RELATIVE} * array_max(held).rate, shiftleft(1L, x.place), 0L))"
        ).alias("mask"),
    )
    table = grams.mapInArrow(_slot_rows, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    rows = table.toPandas()  # at most one row per slot
    masks[rows["slot"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return Filter(langs, masks)


def predict(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Filter | None = None
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of `docs`.

    The prediction looks at the whole text only. Null texts and texts without
    letters are `und` with score 0; a text none of whose n-grams is known gets the
    alphabetically first language and an even score. A null id is not held out
    and does not train; ids repeated with other texts are rows of their own.
    Without any training row every text is `und`. Other columns are not looked
    at; an empty table gives no rows.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.masks))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        filter_ = Filter(*held.value)
        for texts in parts:
            rows = [filter_.decide(t) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    decide = F.pandas_udf(run, "lang_pred string, score double")
    return docs.select(
        F.col(id_col).alias(id_col),
        F.coalesce(common.fraction(F.col(id_col), HELD_OUT_OF) == HELD_OUT, F.lit(False)).alias("held_out"),
        decide(F.coalesce(F.col(text_col), F.lit(""))).alias("found"),
    ).select(id_col, "held_out", "found.lang_pred", "found.score")
