"""Near-duplicate vectors by spherical-cap filters.

The filters are a structured random product code: in each of many tables the
randomly rotated space is cut into two halves, each half has its own random
directions, and every pair of a left and a right direction is one filter
direction. A vector is list-decoded to all filters whose inner product with it
exceeds the cap height, without enumerating the products. Vectors with one label
that share a filter are candidates and are verified in double precision.

Buckets are compared in blocks of bounded size. A pair is counted only in its
smallest common filter, so link counts are sums over blocks, and a block passes
on a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common

THRESHOLD = 0.93
TABLES, DIRECTIONS, HEIGHT, TURNS = 512, 96, 4.2, 16
LOW_DIMS, LOW_CODE = 16, (64, 4, 1.5)
BLOCK_ROWS = 512
FINITE = (
    "size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    " and exists(vector, x -> x <> 0)"
)
TAKES_PART = f"id is not null and label is not null and {FINITE}"


class ProductCode:
    """Random filter directions for `dims` dimensions, the same in every task."""

    def __init__(
        self, dims: int, tables: int = TABLES, directions: int = DIRECTIONS, height: float = HEIGHT, turns: int = TURNS
    ) -> None:
        rng = np.random.default_rng([7, dims, tables, directions])
        self.rotations = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(turns)]
        self.cut = (dims + 1) // 2
        self.left = rng.standard_normal((tables, self.cut, directions))
        self.right = rng.standard_normal((tables, dims - self.cut, directions))
        self.height = height

    @classmethod
    def of(cls, dims: int) -> ProductCode:
        """The default code; vectors of few dimensions take wide caps, as narrow ones are hit or missed together."""
        return cls(dims) if dims >= LOW_DIMS else cls(dims, *LOW_CODE)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """All filters exceeded by each unit vector, ascending.

        A filter's score is the sum of the two halves' Gaussian inner products,
        standard normal over random directions. Left directions that cannot
        reach the height with the best right one are passed over.
        """
        rows, filters = [], []
        turned = [unit @ r for r in self.rotations]
        directions = self.left.shape[2]
        for table, (left, right) in enumerate(zip(self.left, self.right, strict=True)):
            x = turned[table % len(turned)]
            a, b = x[:, : self.cut] @ left, x[:, self.cut :] @ right
            row, i = np.nonzero(a >= (self.height - b.max(axis=1))[:, None])
            entry, j = np.nonzero(b[row] >= (self.height - a[row, i])[:, None])
            rows.append(row[entry])
            filters.append((table * directions + i[entry]) * directions + j)
        row, found = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((found, row))
        return np.split(found[order], np.cumsum(np.bincount(row, minlength=len(unit)))[:-1])


def clean_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors): not null, not zero, all components finite."""
    rows, vectors = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                rows.append(i)
                vectors.append(x)
    return np.array(rows, np.int64), vectors


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes: dict[int, ProductCode] = {}
    for batch in batches:
        rows, vectors = clean_vectors(batch.column(2))
        by_dims: dict[int, list[int]] = {}
        for place, vector in enumerate(vectors):
            by_dims.setdefault(len(vector), []).append(place)
        for dims, places in by_dims.items():
            if dims not in codes:
                codes[dims] = ProductCode.of(dims)
            matrix = np.stack([vectors[p] for p in places])
            matrix /= np.abs(matrix).max(axis=1, keepdims=True)
            unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
            found = codes[dims].decode(unit)
            taken = pa.array(rows[places])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(taken) for k in (0, 1, 3)),
                    pa.array([u.tobytes() for u in unit], pa.binary()),
                    common.lists(np.concatenate(found).astype(np.int32), [len(x) for x in found]),
                ],
                names=["node", "label", "copies", "unit", "filters"],
            )


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    edges, open_ = [], linked.any(axis=1)
    while open_.any():
        seed = int(np.argmax(open_))
        frontier = [seed]
        open_[seed] = False
        while frontier:
            after = []
            for node in frontier:
                reached = np.flatnonzero(linked[node] & open_)
                open_[reached] = False
                edges += [(node, x) for x in reached.tolist()]
                after += reached.tolist()
            frontier = after
    return edges


def _first_common(filters_a: list[np.ndarray], filters_b: list[np.ndarray], this: int) -> np.ndarray:
    """True where `this` is the smallest filter that a row of a and a row of b share."""
    below_a = [x[x < this] for x in filters_a]
    below_b = [x[x < this] for x in filters_b]
    known = np.unique(np.concatenate(below_a)) if below_a else np.empty(0, np.int32)
    if not len(known):
        return np.ones((len(filters_a), len(filters_b)), bool)

    def marks(below: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(below)
        rows = np.repeat(np.arange(len(below)), [len(x) for x in below])
        places = np.searchsorted(known, flat)
        places[places == len(known)] = 0
        hit = known[places] == flat
        out = np.zeros((len(below), len(known)), np.float32)
        out[rows[hit], places[hit]] = 1
        return out

    return marks(below_a) @ marks(below_b).T == 0


def _compare(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def block(rows: pa.Table) -> pa.RecordBatch | None:
        side = rows["side"].to_numpy()
        nodes, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        units = [np.frombuffer(x, np.float64) for x in rows["unit"].to_pylist()]
        this = rows["filter"][0].as_py()
        pairs: list[tuple[int, int]] = []
        links = np.zeros(len(nodes), np.int64)
        sizes = np.array([len(x) for x in units])
        within = bool((side == 0).all())
        for dims in np.unique(sizes):
            a = np.flatnonzero((sizes == dims) & (side == 0))
            b = a if within else np.flatnonzero((sizes == dims) & (side == 1))
            if not len(a) or not len(b):
                continue
            near = np.stack([units[i] for i in a]) @ np.stack([units[i] for i in b]).T >= threshold
            if within:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            # Only rows with a link need their filters looked at.
            i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            lists = rows["filters"]
            near = near[np.ix_(i, j)]
            near &= _first_common(
                [np.array(lists[int(x)].as_py()) for x in a[i]], [np.array(lists[int(x)].as_py()) for x in b[j]], this
            )
            links[a[i]] += near @ copies[b[j]]
            if not within:
                links[b[j]] += near.T @ copies[a[i]]
            square = np.zeros((len(nodes), len(nodes)), bool)
            square[np.ix_(a[i], b[j])] = near
            pairs += forest(square | square.T)
        some = np.flatnonzero(links)
        if not len(some) and not pairs:
            return None
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*nodes[some].tolist(), *(int(nodes[x]) for x, _ in pairs)], pa.int64()),
                pa.array([*[None] * len(some), *(int(nodes[y]) for _, y in pairs)], pa.int64()),
                pa.array([*links[some].tolist(), *[0] * len(pairs)], pa.int64()),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.grouped_blocks(batches, ["label", "filter", "left_block", "right_block"]):
            if rows.num_rows > 1:
                found = block(rows)
                if found is not None:
                    yield found

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors`.

    Vectors are linked when their labels are equal and not null and their cosine
    is at least `threshold`. n_links counts the other rows linked directly;
    component_id is the smallest id reachable by links.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows with a null label or a null id, link with nothing: n_links 0, their own
    id as component, kept. Vectors of different lengths are never linked.
    Repeated rows are copies that link with each other. Other columns are not
    looked at; an empty table gives no rows.
    """
    common.prepare(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).withColumn("node", F.xxhash64("label", "vector"))
    # Equal vectors of a label are one node with a number of copies.
    usable = rows.where(TAKES_PART)
    classes = common.stored(
        usable.groupBy("node", "label").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")
        ),
        "caps-classes",
    )
    decoded = common.stored(
        classes.select("node", "label", "vector", "copies").mapInArrow(
            _filters,
            "node bigint, label string, copies bigint, unit binary, filters array<int>",
        ),
        "caps-filters",
    )
    entries = decoded.select("node", "label", "copies", "unit", "filters", F.explode("filters").alias("filter"))
    sizes = decoded.select("label", F.explode("filters").alias("filter")).groupBy("label", "filter").agg(
        F.count("*").alias("members")
    )
    blocks = sizes.where("members > 1").select(
        "label", "filter", F.ceil(F.col("members") / block_rows).cast("int").alias("blocks")
    )
    entries = entries.join(blocks, ["label", "filter"]).withColumn(
        "block", F.pmod(F.xxhash64("node", "filter"), F.col("blocks")).cast("int")
    )
    # Every block meets itself and each other block of its bucket once.
    paired = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label",
        "filter",
        F.least("block", "other").alias("left_block"),
        F.greatest("block", "other").alias("right_block"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
        "node",
        "copies",
        "unit",
        "filters",
    )
    keys = ["label", "filter", "left_block", "right_block"]
    found = common.stored(
        paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "a bigint, b bigint, links bigint"),
        "caps-links",
    )
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = common.components(found.where("b is not null").select("a", "b"))
    least = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    named = common.stored(
        classes.select("node", "rep", "copies")
        .join(linked.join(least, "component").select("node", "least"), "node", "left")
        .join(links, "node", "left")
        .select(
            "node",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("least", "rep").alias("component_id"),
        ),
        "caps-components",
    )
    return (
        rows.withColumn("node", F.when(F.expr(TAKES_PART), F.col("node")))
        .select("id", "node")
        .join(named, "node", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
    )
