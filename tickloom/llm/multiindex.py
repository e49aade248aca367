"""Nearest neighbours by largest inner product in an inverted multi-index.

Both halves of the vectors are quantised by codebooks of their own, so an entry
lies in the cell of a left and a right centroid. A query walks the cells in the
order of summed distance (the negative inner products of its halves with the
centroids) with a heap, until the visited cells hold a given share of all
entries, and all entries of the visited cells are reranked on the original
vectors. The walk ends at a summed distance, so which right cells of a left
centroid are visited is one number; queries and entries meet by left centroid,
in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import common
from tickloom.llm.capfilter import FINITE

CENTROIDS = 64
MOST_FITTED = 20_000
SHARE = 0.5
ENTRY_BLOCK, QUERY_BLOCK = 2048, 1024


def k_means(points: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(3)
    distinct = np.unique(points, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:count]]
    for _ in range(rounds):
        nearest = closest(points, centroids)
        sizes = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def closest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * points @ centroids.T, axis=1)


class Codebooks:
    """Centroids of the two halves."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left, self.right = left, right
        self.cut = left.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, count: int) -> Codebooks:
        cut = (sample.shape[1] + 1) // 2
        return cls(k_means(sample[:, :cut], count), k_means(sample[:, cut:], count))

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return closest(vectors[:, : self.cut], self.left), closest(vectors[:, self.cut :], self.right)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -(vectors[:, : self.cut] @ self.left.T), -(vectors[:, self.cut :] @ self.right.T)


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, enough: int) -> float:
    """Summed distance at which the visited cells hold `enough` entries.

    Multi-sequence walk over the sorted halves: a pair (i, j) enters the heap
    when (i - 1, j) and (i, j - 1) have left it.
    """
    rows, columns = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    near, far = left[rows].tolist(), right[columns].tolist()
    held = sizes[np.ix_(rows, columns)].tolist()
    heap, reached, total, last = [(near[0] + far[0], 0, 0)], [0] * len(near), 0, 0.0
    while heap:
        last, i, j = heapq.heappop(heap)
        total += held[i][j]
        if total >= enough:
            return last
        reached[i] = j + 1
        if j + 1 < len(far) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (near[i] + far[j + 1], i, j + 1))
        if i + 1 < len(near) and reached[i + 1] == j:
            heapq.heappush(heap, (near[i + 1] + far[j], i + 1, j))
    return float("inf")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _index(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = books.cells(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))],
                    names=["id", "vector", "left", "right"],
                )

    return run


def _probes(books: Codebooks, sizes: np.ndarray, enough: int):
    """A row per query and visited left centroid, with the distance its right centroid may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near, far = books.distances(_matrix(batch.column(1)))
            rows, lefts, limits = [], [], []
            for row, (a, b) in enumerate(zip(near, far, strict=True)):
                limit = walk(a, b, sizes, enough) - a
                open_ = np.flatnonzero(limit >= b.min() - 1e-12)
                rows += [row] * len(open_)
                lefts += open_.tolist()
                limits += limit[open_].tolist()
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(lefts, pa.int32()), pa.array(limits, pa.float64())],
                names=["id", "vector", "left", "limit"],
            )

    return run


def best(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, visited: np.ndarray, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, entry row, score) of each query's `most` best visited entries, its own row left out."""
    rough = np.where(visited & (query_ids[:, None] != ids), queries @ vectors.T, -np.inf)
    if rough.shape[1] > most:
        bound = np.partition(rough, -most, axis=1)[:, -most]
        rough[rough < (bound - 1e-9 * (1 + np.abs(bound)))[:, None]] = -np.inf
    q, e = np.nonzero(rough > -np.inf)
    # Row by row, so that equal vectors get equal scores wherever they stand.
    score = (queries[q] * vectors[e]).sum(axis=1)
    order = np.lexsort((ids[e], -score, q))
    q, e, score = q[order], e[order], score[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = place < most
    return q[keep], e[keep], score[keep]


def _rerank(books: Codebooks, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.grouped_blocks(batches, ["left", "entry_block", "query_block"]):
            limit = rows["limit"].to_numpy(zero_copy_only=False)
            is_query = ~np.isnan(limit)
            if is_query.all() or not is_query.any():
                continue
            vectors = np.array(rows["vector"].to_pylist(), np.float64)
            ids, right = rows["id"].to_numpy(), rows["right"].to_numpy()
            queries, entries = vectors[is_query], vectors[~is_query]
            far = books.distances(queries)[1]
            visited = far[:, right[~is_query]] <= limit[is_query][:, None] + 1e-12
            q, e, score = best(ids[is_query], queries, ids[~is_query], entries, visited, most)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[is_query][q]), pa.array(ids[~is_query][e]), pa.array(score)],
                names=["query_id", "vec_id", "score"],
            )

    return run


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    neighbours: int = 20,
    centroids: int = CENTROIDS,
    share: float = SHARE,
    most_fitted: int = MOST_FITTED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's best rows of `vectors` by inner product.

    The codebooks are fitted on about `most_fitted` vectors chosen by a hash of
    id and vector, so copies are not chosen together; every vector is indexed. A query visits cells until they hold
    `share` of all entries, and at least neighbours + 1 of them. Scores are in
    double precision, ties go to the smaller id, a query never finds its own id.

    Vectors that are null, empty, zero or hold null or non-finite components,
    vectors whose length is not the commonest one, and rows without an id take no
    part. A repeated id is one entry per row. Other columns are not looked at; an
    empty side gives no rows.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    schema = "query_id long, rank int, vec_id long, score double"

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return rows.where(f"id is not null and {FINITE}")

    entries = usable(vectors)
    lengths = entries.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))
    common_length = lengths.orderBy(F.desc("n"), "dims").first()
    if common_length is None:
        return spark.createDataFrame([], schema)
    dims, number = common_length["dims"], common_length["n"]
    entries = entries.where(F.size("vector") == dims)
    part = min(1.0, most_fitted / number)
    hashed = F.pmod(F.xxhash64("id", "vector"), F.lit(2**20))
    sample = entries.where(hashed <= int(part * 2**20)).select("id", "vector").distinct().toPandas()
    sample = sample if len(sample) else entries.select("id", "vector").limit(1).toPandas()
    books = Codebooks.fit(np.stack(sample.sort_values("id")["vector"].to_list()).astype(float), centroids)

    indexed = common.stored(
        entries.mapInArrow(_index(books), "id bigint, vector array<double>, left int, right int"), "multi-index"
    )
    cells = indexed.groupBy("left", "right").agg(F.count("*").alias("n")).collect()  # at most centroids squared
    sizes = np.zeros((len(books.left), len(books.right)), np.int64)
    for cell in cells:
        sizes[cell["left"], cell["right"]] = cell["n"]
    enough = max(neighbours + 1, int(np.ceil(share * number)))
    asked = usable(queries).where(F.size("vector") == dims)
    probes = common.stored(
        asked.mapInArrow(_probes(books, sizes, enough), "id bigint, vector array<double>, left int, limit double"),
        "multi-probes",
    )
    asked_by = {r["left"]: r["n"] for r in probes.groupBy("left").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame(
        [
            (left, max(1, -(-int(n) // ENTRY_BLOCK)), max(1, -(-asked_by.get(left, 0) // QUERY_BLOCK)))
            for left, n in enumerate(sizes.sum(axis=1).tolist())
        ],
        "left int, entry_blocks int, query_blocks int",
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = lambda n: F.pmod(F.xxhash64("id", "left"), F.col(n)).cast("int")
    sides = (
        indexed.join(F.broadcast(blocks), "left")
        .withColumn("entry_block", spread("entry_blocks"))
        .withColumn("query_block", every("query_blocks"))
        .select("left", "entry_block", "query_block", "id", "vector", "right", F.lit(float("nan")).alias("limit"))
    ).union(
        probes.join(F.broadcast(blocks), "left")
        .withColumn("query_block", spread("query_blocks"))
        .withColumn("entry_block", every("entry_blocks"))
        .select("left", "entry_block", "query_block", "id", "vector", F.lit(0).alias("right"), "limit")
    )
    keys = ["left", "entry_block", "query_block"]
    found = (
        sides.repartition(*keys)
        .sortWithinPartitions(*keys, "id")
        .mapInArrow(_rerank(books, neighbours), "query_id bigint, vec_id bigint, score double")
    )
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")
