"""Near-duplicate documents by min-max hashing of word shingles.

Every hash function gives two signature values, its minimum and its maximum over
the shingles, so a band costs half the hash evaluations of plain minwise
hashing. Documents that share a band are candidates; every link is confirmed on
the full shingle sets.

Work on copies: equal sets fall into one class by a 64-bit digest. In a bucket
the members are first compared with its smallest member only. Documents that
still share a bucket with another component afterwards go through an exact
similarity join with prefix filtering, in which loosely edited copies of one
text, similar but not enough, do not meet. No link between candidates is lost:
two members of one bucket are connected already or are found by the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common

SEED = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_WORDS = 5
BANDS, BAND_VALUES = 28, 5
CLASSES = 128
FILTER_BITS = common.FILTER_BITS


def shingles(text: bytes, hashes: common.WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text; empty without words."""
    found = common.words(text)
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(width, len(ids))
    with np.errstate(over="ignore"):
        value = np.full(len(ids) - size + 1, size, np.uint64)
        for k in range(size):
            value = value * SEED + ids[k : len(ids) - size + 1 + k]
        return np.unique(common.mixed(value))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**32, count, np.uint32), rng.integers(0, 2**31, count, np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(found: np.ndarray, bands: int, values: int) -> np.ndarray:
    """One 64-bit key per band over alternating minima and maxima."""
    count = -(-bands * values // 2)
    flips, factors = _functions(count)
    low = np.full(count, 2**32 - 1, np.uint32)
    high = np.zeros(count, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 2048):
        block = (short[start : start + 2048, None] ^ flips) * factors
        np.minimum(low, block.min(axis=0), out=low)
        np.maximum(high, block.max(axis=0), out=high)
    signature = np.stack([low, high], axis=1).reshape(-1)[: bands * values].reshape(bands, values)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(values):
            key = common.mixed(key * SEED + signature[:, k])
    return key


def node_of(found: np.ndarray) -> int:
    """Signed 64-bit digest of a shingle set; equal sets are one node."""
    value = xxhash.xxh3_64_intdigest(found.tobytes())
    return value - 2**64 if value >= 2**63 else value


def _signatures(bands: int, values: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, hashes, width)
                sizes.append(len(found))
                nodes.append(node_of(found))
                keys.append(common.signed(band_keys(found, bands, values)))
            hashes.trim()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    common.lists(np.stack(keys) if keys else np.empty((0, bands), np.int64)),
                ],
                names=["id", "n", "node", "bands"],
            )
        common.release(hashes)

    return run


def spread(found: np.ndarray) -> np.ndarray:
    """Number of shingles in each of `CLASSES` hash classes; two sets share at most the sum of the smaller ones."""
    return np.bincount((found & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES).astype(np.int32)


def _sets(width: int):
    """Whole shingle sets, as bytes, of the texts that have a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in batches:
            found = [shingles(text, hashes, width) for text in batch.column(1).to_pylist()]
            hashes.trim()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([node_of(x) for x in found], pa.int64()),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                    common.lists(np.stack([spread(x) for x in found]) if found else np.empty((0, CLASSES), np.int32)),
                ],
                names=["id", "node", "set", "spread"],
            )
        common.release(hashes)

    return run


def _confirm(percent: int):
    """Keeps the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                left, right = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(_confirm(percent), "a bigint, b bigint")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))],
            names=["node", "shingle"],
        )


def _prefixes(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, part, spread, left): the rarest shingles of every node of `nodes(node, n, part)`.

    With all sets in one order, two sets of the wanted similarity share a shingle
    among the first n - ceil(percent * n / 100) + 1 of each. The order is by the
    number of nodes that hold a shingle, so what many near copies have in common
    comes last. `left` counts the set's shingles from this one on.
    """
    rows = sets.join(nodes.select("node"), "node", "left_semi").select("node", "set")
    rows = rows.mapInArrow(_exploded, "node bigint, shingle bigint")
    held = rows.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    # A shingle of one node alone comes first and finds no partner: only its number matters.
    common_ones = rows.join(held, "shingle").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("ordered")
    )
    taken = common_ones.join(nodes, "node").withColumn("alone", F.col("n") - F.size("ordered")).withColumn(
        "prefix", (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")).cast("int")
    )
    # The smallest partner has ceil(percent * n / 100) shingles; it must find enough from here on.
    return (
        taken.where("prefix > 0")
        .join(sets.select("node", "spread"), "node")
        .select(
            *("node", "n", "part", "alone", "spread"),
            F.posexplode(F.slice("ordered", F.lit(1), F.col("prefix"))).alias("at", "x"),
        )
        .select("x.shingle", "node", "n", "part", "spread", (F.col("n") - F.col("alone") - F.col("at")).alias("left"))
        .where(f"{percent} * (n + ceil({percent} * n / 100)) <= {100 + percent} * left")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    width: int = SHINGLE_WORDS,
    bands: int = BANDS,
    values: int = BAND_VALUES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs`.

    Two documents are linked when 100 * |A & B| >= percent * |A | B|.
    `component_id` is the smallest id reachable by links, `kept` marks it. A
    pair at the threshold is missed with probability (1 - s^values)^bands:
    8e-8 for 0.85, 1.5e-5 for 0.8.

    Null text, empty text and text of white space have the empty set and link
    with nothing. Rows without an id link with nothing either; their component
    is null and they are kept. Every row is a document of its own, also where an
    id is repeated. Other columns of `docs` are not looked at. An empty table
    gives no rows.
    """
    return _with_nodes(docs, id_col, text_col, percent, width, bands, values).drop("_node")


def _with_nodes(
    docs: DataFrame, id_col: str, text_col: str, percent: int, width: int = SHINGLE_WORDS, bands: int = BANDS, values: int = BAND_VALUES
) -> DataFrame:
    """`near_duplicates` with the digest of every row's shingle set, as _node."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), common.text_bytes(F.col(text_col)).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    signatures = common.stored(
        rows.mapInArrow(_signatures(bands, values, width), f"id {id_type}, n bigint, node bigint, bands array<bigint>"),
        "minmax",
    )
    classes = (
        signatures.where("n > 0 and id is not null")
        .groupBy("node")
        .agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    )
    buckets = common.stored(classes.select("node", "rep", "n", F.explode("bands").alias("bucket")), "minmax-buckets")
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = common.stored(buckets.join(shared.select("bucket", "hub"), "bucket"), "minmax-members")
    busy = members.select(F.col("rep").alias("id"), "node").distinct()
    wanted = busy.select("id").distinct()
    sets = (
        rows.where(common.may_be_in(wanted, FILTER_BITS)(F.col("id")))
        .join(wanted, "id", "left_semi")
        .select("id", "text")
        .mapInArrow(_sets(width), f"id {id_type}, node bigint, set binary, spread array<int>")
    )
    # A repeated id can bring texts of other nodes, and repeated rows the same node twice.
    sets = common.stored(sets.join(busy, ["id", "node"], "left_semi").dropDuplicates(["node"]), "minmax-sets")

    similar = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    hubs = members.select(F.col("node").alias("hub"), F.col("n").alias("n_a")).distinct()
    stars = common.stored(
        members.where("node <> hub")
        .select("hub", F.col("node").alias("b"), F.col("n").alias("n_b"))
        .distinct()
        .join(hubs, "hub")
        .where(similar)
        .select(F.col("hub").alias("a"), "b"),
        "minmax-stars",
    )
    first = common.stored(_confirmed(stars, sets, percent), "minmax-links")

    # What a bucket still holds in different components is joined in full, by prefix filtering.
    placed = members.select("bucket", "node", "n").join(common.components(first), "node", "left")
    placed = placed.select("bucket", "node", "n", F.coalesce("component", "node").alias("part"))
    parts = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    open_ = placed.join(parts.where("low < high").select("bucket"), "bucket", "left_semi")
    open_ = common.stored(open_.select("node", "n", "part").distinct(), "minmax-open")
    rare = common.stored(_prefixes(sets, open_, percent), "minmax-prefixes")
    sides = ("node", "x"), ("n", "n_a"), ("left", "left_a"), ("spread", "spread_a")
    near = rare.select("shingle", "part", *(F.col(c).alias(name) for c, name in sides))
    sides = ("part", "part_b"), ("node", "y"), ("n", "n_b"), ("left", "left_b"), ("spread", "spread_b")
    far = rare.select("shingle", *(F.col(c).alias(name) for c, name in sides))
    # The first common shingle of a similar pair leaves room for all the others, and the hash classes do too.
    enough = F.expr(f"{percent} * (n_a + n_b) <= {100 + percent} * least(left_a, left_b)")
    roomy = F.expr(
        f"{percent} * (n_a + n_b) <= {100 + percent} * "
        "aggregate(zip_with(spread_a, spread_b, (p, q) -> least(p, q)), 0, (s, v) -> s + v)"
    )
    rest = (
        near.join(far, "shingle")
        .where("x < y and part <> part_b")
        .where(similar & enough & roomy)
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    second = common.stored(_confirmed(rest, sets, percent), "minmax-more")
    linked = common.components(first.union(second))

    least = (
        linked.join(classes.select("node", "rep"), "node")
        .groupBy("component")
        .agg(F.min("rep").alias("component_id"))
    )
    named = classes.select("node", "rep").join(linked.join(least, "component"), "node", "left")
    named = common.stored(
        named.select("node", F.coalesce("component_id", "rep").alias("component_id")), "minmax-components"
    )
    return (
        signatures.select("id", "n", "node")
        .join(named, "node", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id")))
            .otherwise(F.col("id"))
            .alias("component_id"),
            F.col("node").alias("_node"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
    )


def _node_udf(width: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = common.WordHashes()
        for texts in parts:
            yield pd.Series([node_of(shingles(text, hashes, width)) for text in texts], dtype="int64")
            hashes.trim()
        common.release(hashes)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "bigint")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of `docs` whose document is the smallest id of its near-duplicate group.

    Documents without an id and documents without words are groups of their own.
    Rows that repeat an id are decided each by its own text; of those that
    repeat id and text, one row stays. Rows without an id all stay. All columns
    are kept, whatever their names.
    """
    kept_id, kept_node, own_node = common.unused(docs, "_kept_id", "_kept_node", "_own_node")
    found = _with_nodes(docs, id_col, text_col, percent).where(F.col(id_col).isNotNull())
    kept = found.groupBy(F.col(id_col).alias(kept_id), F.col("_node").alias(kept_node)).agg(
        F.count("*").alias("_rows"), F.max("kept").alias("_kept")
    )
    kept = common.stored(kept, "kept-ids")
    ids = kept.groupBy(kept_id).agg(F.sum("_rows").alias("_rows"), F.max("_kept").alias("_kept")).where("_kept")
    # Rows that are surely not among those to be decided stay where they are; the others' texts are shuffled.
    all_ids = kept.groupBy(kept_id).agg(F.sum("_rows").alias("_rows"), F.min("_kept").alias("_all"))
    open_ = common.may_be_in(all_ids.where("_rows > 1 or not _all").select(F.col(kept_id).alias("id")), FILTER_BITS)(F.col(id_col))
    here = docs.where(F.col(id_col).isNotNull())
    clear = here.where(~open_)
    once = clear.union(
        here.where(open_).join(ids.where("_rows = 1"), F.col(id_col) == F.col(kept_id), "left_semi")
    ).union(docs.where(F.col(id_col).isNull()))
    if ids.where("_rows > 1").isEmpty():
        return once
    again = here.where(open_).join(ids.where("_rows > 1"), F.col(id_col) == F.col(kept_id), "left_semi")
    again = again.withColumn(own_node, _node_udf(SHINGLE_WORDS)(common.text_bytes(F.col(text_col))))
    same = (F.col(id_col) == F.col(kept_id)) & (F.col(own_node) == F.col(kept_node))
    again = again.join(kept.where("_kept"), same, "left_semi").select(docs.columns).dropDuplicates([id_col, text_col])
    return once.union(again)
