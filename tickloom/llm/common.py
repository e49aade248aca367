"""Helpers shared by the operators: tables, scratch, hashing, distributed components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import session

BATCH_ROWS = "500"
FILTER_BITS = 1 << 24


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small enough for long texts."""
    session.ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder."""
    return session.materialise(df, f"llm-{name}")


def fraction(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, by which rows are held out."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def text_bytes(column: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(column, F.lit("")).cast("binary")


def release(*caches: dict) -> None:
    """Empty a task's caches and give their memory back: Spark keeps Python workers for later tasks."""
    for cache in caches:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class WordHashes(dict):
    """64-bit hash of a word, remembered; cleared by `trim` when it has grown."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def trim(self, most: int = 200_000) -> None:
        if len(self) > most:
            self.clear()


def words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, split at space and \\x09-\\x0D."""
    return text.lower().split()


def strings(column: pa.Array) -> list:
    """Python strings or bytes of a column without nulls; `to_pylist` takes several times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


def coded(split: pa.Array) -> tuple[list[str], pa.Array, np.ndarray]:
    """(distinct pieces, the place of each piece among them, edges) of texts split to lists.

    The pieces of text i have the places edges[i] to edges[i + 1] - 1.
    """
    pieces = split.flatten().dictionary_encode()
    edges = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return strings(pieces.dictionary), pieces.indices, edges


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads all bits of unsigned 64-bit values."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def lists(values: np.ndarray, lengths: Iterable[int] | None = None) -> pa.Array:
    """A list column: rows of a matrix, or runs of a flat array."""
    if lengths is None:
        lengths = np.full(len(values), values.shape[1] if values.ndim == 2 else 0)
        values = values.reshape(-1)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node of `edges(a, b)`, as (node, component).

    Alternates large-star and small-star steps, which keep the connectivity and
    reach stars in a number of rounds that grows with the logarithm of a
    component. Every round is checkpointed in the shared folder; only two
    numbers reach the driver. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(session.scratch_root(spark))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    before = state(current)
    for _ in range(most_rounds):
        if not before[0]:
            break
        current = star(star(current, True), False).checkpoint()
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def may_be_in(ids: DataFrame, bits: int = FILTER_BITS):
    """A test on an id: true for every id of `ids(id)`, and for few others while they fill a small part of the bits.

    The bits have a fixed size. They only spare rows a shuffle; a join decides.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
    )
    filled = np.zeros(bits // 64, np.int64)
    for row in words.collect():
        filled[row["word"]] = row["bits"]
    shared = ids.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    def run(places: pd.Series) -> pd.Series:
        at = places.to_numpy(np.uint64)
        return pd.Series((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    run.__annotations__ = {"places": pd.Series, "return": pd.Series}
    test = F.pandas_udf(run, "boolean")
    return lambda column: test(F.pmod(F.xxhash64(column), F.lit(bits)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores in front as make it differ from every column of `df`."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def one_of(hashed: Column, most: int, rows: int) -> Column:
    """True for about `most` of `rows` rows, by a 64-bit hash; every row if there are no more."""
    return F.shiftrightunsigned(hashed, 2) < F.lit(min(1 << 62, (most << 62) // max(1, rows))).cast("bigint")


def most_frequent(counts: DataFrame, by: str, most: int, fill: str | None = None) -> list:
    """The rows with the largest positive counts `by`, at most `most` of them, in no order.

    A histogram of fixed size over the logarithm of the count gives the count
    from which rows are taken, so the driver never sees more than `most` rows
    and no task sorts. Rows that tie across the limit are left out together, or,
    with `fill`, chosen by a hash of that column, which gives about `most` rows.
    """
    step = F.floor(F.log2(by) * 64)
    sizes = dict(counts.groupBy(step.alias("step")).agg(F.count("*")).collect())
    total, least, across = 0, None, None
    for place in sorted(sizes, reverse=True):
        if total + sizes[place] > most:
            across = place
            break
        total += sizes[place]
        least = place
    wanted = F.lit(False) if least is None else step >= least
    if fill is not None and across is not None:
        wanted |= (step == across) & one_of(F.xxhash64(fill), most - total, sizes[across])
    return counts.where(wanted).collect()


def grouped_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream, one table per run.

    The caller bounds the run length; no run is held beyond its end.
    """
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        if not rest.num_rows:
            continue
        columns = [rest[k].combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(rest.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        edges = [0, *starts.tolist()]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield rest.slice(low, high - low)
        rest = rest.slice(edges[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest
