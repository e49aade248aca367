"""Windows over one key that may hold a large part of all rows.

`Window.partitionBy(stock)` sends a whole instrument to one task. The functions
here cut each key into time slices, so that a slice and not a key is the unit of
work. What a slice needs from before it comes as narrow copies of the rows that
its frames reach back to, or as one *carry row* per (key, slice): the state that
the earlier slices hand over, computed by an ordinary aggregation with map-side
combine. Rolling sums are differences of running sums, so their cost does not
depend on how many rows a frame holds.

Key columns may be NULL; NULL forms a key of its own, as in a plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.measures import order_key
from tickloom.functions.times import slice_start
from tickloom.session import materialise

_SLICE, _AT, _COPY, _OWN = "__slice", "__at", "__copy", "__own"


def rolling_sums(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    width: int,
    measures: Mapping[str, Column],
    slice_width: int,
) -> DataFrame:
    """Add, for each row, the sums of `measures` over rows of its key whose `ts`
    lies in [own ts - width, own ts].

    Measures must be exact (integer or decimal); NULL counts as zero. A sum is the
    running sum up to the row minus the running sum up to the frame's left edge;
    both grow with the rows and are never added up again. Rows that later slices
    look back at are copied into them with their measures alone: about `width` by
    `slice_width` of all rows. The input is read once.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    names = list(measures)
    held = {n: f"__m_{i}" for i, n in enumerate(names)}

    first = slice_start(F.col(ts), slice_width)
    seen_by = F.sequence(first, slice_start(F.col(ts) + F.lit(width), slice_width), F.lit(slice_width).cast("bigint"))
    valued = df.select(
        *keys,
        *payload,
        F.col(ts).alias(_AT),
        *[F.coalesce(m, F.lit(0)).alias(held[n]) for n, m in measures.items()],
        F.posexplode(F.coalesce(seen_by, F.array(first))).alias(_COPY, _SLICE),
    )
    own = F.col(_COPY) == 0
    rows = valued.select(
        *keys,
        _SLICE,
        _AT,
        own.alias(_OWN),
        *[F.when(own, F.col(c)).alias(c) for c in payload],
        *held.values(),
    )
    in_time = Window.partitionBy(*keys, _SLICE).orderBy(_AT)
    upto_now = in_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before_frame = in_time.rangeBetween(Window.unboundedPreceding, -(width + 1))
    return (
        rows.select(
            *keys,
            *payload,
            _OWN,
            *[
                (F.sum(held[n]).over(upto_now) - F.coalesce(F.sum(held[n]).over(before_frame), F.lit(0))).alias(n)
                for n in names
            ],
        )
        .filter(F.col(_OWN))
        .select(*df.columns, *names)
    )


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seq: str,
    value: Column,
    slice_width: int,
    name: str,
) -> DataFrame:
    """Add the latest non-NULL `value` of the same key up to and including this row.

    Rows are ordered by (`ts`, `seq`), both non-negative integers.
    """
    keys = list(keys)
    rows = df.withColumns({"__v": value, _SLICE: slice_start(F.col(ts), slice_width)})

    # The newest value of each slice, then of all slices before it. The order is
    # one decimal, which keeps this a hash aggregation.
    known = F.when(F.col("__v").isNotNull(), order_key(F.col(ts), F.col(seq)))
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, _SLICE)
        .agg(F.max_by("__v", known).alias("__newest"))
        .select(
            *keys,
            _SLICE,
            F.col(_SLICE).alias(ts),
            F.last("__newest", ignorenulls=True).over(before).alias("__v"),
            F.lit(True).alias("__carry"),
        )
    )

    # A carry row has no seq and stands at the slice start, so it sorts first.
    upto_now = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(ts, F.col(seq).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .withColumn(name, F.last("__v", ignorenulls=True).over(upto_now))
        .filter(F.col("__carry").isNull())
        .select(*df.columns, name)
    )


def numbered(
    df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None
) -> DataFrame:
    """Add the row number 0..n-1 over the whole table in the given order.

    Give an order that is total, and for a large table the number of partitions.

    Rows are range-partitioned and sorted, so a row's number is the count of rows
    in earlier partitions plus its place in its own. The sorted rows are written
    once with both parts in one id; nothing is computed again after that, so a
    lost executor cannot move a row to another partition.
    """
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order)
    ranged = ranged.sortWithinPartitions(*order)
    # The id holds the partition above bit 33 and the place in it below.
    table = materialise(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    rows = table.withColumns(
        {
            "__part": F.shiftright("__id", 33),
            "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, whatever the size of the table.
    starts = (
        rows.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    return (
        rows.join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__place"))
        .select(*df.columns, name)
    )


def running_total(
    df: DataFrame, keys: Sequence[str], at: str, amount: Column, slice_width: int, name: str
) -> DataFrame:
    """Add the sum of `amount` over rows of the same key with `at` up to this row's."""
    keys = list(keys)
    rows = df.withColumns({"__m": amount, _SLICE: slice_start(F.col(at), slice_width)})
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, _SLICE)
        .agg(F.sum("__m").alias("__m"))
        .select(
            *keys,
            _SLICE,
            F.col(_SLICE).alias(at),
            F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__m"),
            F.lit(True).alias("__carry"),
        )
    )
    upto_now = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(at)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .withColumn(name, F.sum("__m").over(upto_now))
        .filter(F.col("__carry").isNull())
        .select(*df.columns, name)
    )

