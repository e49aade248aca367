import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tape import column
from tickloom.operators.slices import last_known, numbered, rolling_sums, running_total


def _points(seed, n=400, keys=("a", "b", None), span=300):
    rng = random.Random(seed)
    return [
        (rng.choice(keys), rng.randrange(span), i, rng.choice([None, *range(-5, 9)]))
        for i in range(n)
    ]


def _table(spark, points):
    return spark.createDataFrame(points, "k string, t bigint, i bigint, v bigint")


@pytest.mark.parametrize("width,slice_width", [(0, 1), (7, 3), (10, 10), (50, 7), (500, 40)])
def test_rolling_sums(spark, width, slice_width):
    points = _points(width)
    wanted = {
        i: (
            sum(w or 0 for h, u, _, w in points if h == k and t - width <= u <= t),
            sum(1 for h, u, _, w in points if h == k and t - width <= u <= t),
        )
        for k, t, i, _ in points
    }
    got = rolling_sums(
        _table(spark, points),
        ["k"],
        "t",
        width,
        {"s": F.col("v"), "n": F.lit(1)},
        slice_width,
    )
    assert got.columns == ["k", "t", "i", "v", "s", "n"]
    assert {r.i: (r.s, r.n) for r in got.collect()} == wanted


def test_rolling_sums_keep_rows(spark):
    points = _points(1)
    got = rolling_sums(_table(spark, points), ["k"], "t", 9, {"s": F.col("v")}, 4).drop("s")
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, points))


@pytest.mark.parametrize("slice_width", [1, 13, 1000])
def test_last_known(spark, slice_width):
    points = _points(slice_width)
    wanted = {}
    for k, t, i, _ in points:
        seen = sorted((u, j, w) for h, u, j, w in points if h == k and (u, j) <= (t, i))
        known = [w for _, _, w in seen if w is not None]
        wanted[i] = known[-1] if known else None
    got = last_known(
        _table(spark, points), ["k"], "t", "i", F.col("v"), slice_width, "last"
    )
    assert column(got, "i", "last") == wanted


def test_last_known_equals_plain_window(spark):
    table = _table(spark, _points(4, 2_000, span=5_000))
    window = Window.partitionBy("k").orderBy("t", "i")
    plain = table.withColumn("last", F.last("v", ignorenulls=True).over(window))
    sliced = last_known(table, ["k"], "t", "i", F.col("v"), 50, "last")
    assert column(plain, "i", "last") == column(sliced, "i", "last")


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_numbered(spark, coalesce):
    rng = random.Random(6)
    points = [(rng.choice([None, *range(40)]), i) for i in range(600)]
    table = spark.createDataFrame(points, "t bigint, i bigint").repartition(5)
    ordered = sorted(points, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    wanted = {i: n for n, (_, i) in enumerate(ordered)}
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(setting, coalesce)
        assert column(numbered(table, ["t", "i"], "n"), "i", "n") == wanted
    finally:
        spark.conf.unset(setting)


def test_numbered_by_text(spark):
    points = [(f"{i % 7}", i) for i in range(50)]
    table = spark.createDataFrame(points, "t string, i bigint")
    wanted = {i: n for n, (_, i) in enumerate(sorted(points))}
    assert column(numbered(table, ["t", "i"], "n"), "i", "n") == wanted


def test_numbered_empty(spark):
    assert numbered(_table(spark, []), ["t"], "n").isEmpty()


def test_running_total(spark):
    points = [(k, t, i, v) for k, t, i, v in _points(8) if v is not None]
    wanted = {
        i: sum(w for h, u, _, w in points if h == k and u <= t) for k, t, i, _ in points
    }
    got = running_total(_table(spark, points), ["k"], "t", F.col("v"), 20, "s")
    assert column(got, "i", "s") == wanted
