"""Grouped summaries of trades.

Prices enter as whole ticks and are summed as integers or decimals, so a result
does not depend on the order of rows or the number of partitions. Every group-by
combines on the map side; a hot stock reaches the shuffle as one row per task
and group.

Where a directory is passed, trades are summed per stock first and the category
is attached to the sums. A stock with several directory rows then repeats its
sums, not its trades; the result is the same as summing the joined trades.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import measures
from tickloom.functions.times import MINUTE_NS, by_day
from tickloom.operators import rows
from tickloom.operators.joins import dimension_keys


def trade_sums() -> list[Column]:
    """The exact sums all trade summaries are made of."""
    ticks, shares = F.col("price_ticks"), F.col("shares")
    return [
        F.sum(shares).alias("shares_sum"),
        F.sum(measures.notional(ticks, shares)).alias("notional_sum"),
        F.sum(ticks).alias("ticks_sum"),
        F.count(ticks).alias("priced"),
        F.count(F.lit(1)).alias("n"),
    ]


def candle_columns() -> list[Column]:
    """Low, high, open, close, VWAP and volume; open and close by (time, place in file)."""
    ticks, shares = F.col("price_ticks"), F.col("shares")
    when = measures.order_key(F.col("ts_ns"), F.col("seq"))
    return [
        measures.price(F.min(ticks)).alias("low"),
        measures.price(F.max(ticks)).alias("high"),
        measures.price(F.min_by(ticks, when)).alias("open"),
        measures.price(F.max_by(ticks, when)).alias("close"),
        measures.vwap(F.sum(measures.notional(ticks, shares)), F.sum(shares)).alias("vwap"),
        F.sum(shares).alias("volume"),
    ]


def _by_category(
    trades: DataFrame, directory: DataFrame | None, by: Sequence[str]
) -> DataFrame:
    """Sums per (by, market_cat) and `repeats`, how often the category repeats them.

    Without a directory the trades are already enriched and count once.
    """
    by = by_day(trades, *by)
    if directory is None:
        return trades.groupBy(*by, "market_cat").agg(*trade_sums()).withColumn("repeats", F.lit(1))
    on = dimension_keys(trades, directory)
    repeats = directory.groupBy(*on, "market_cat").agg(F.count(F.lit(1)).alias("repeats"))
    return trades.groupBy(*by).agg(*trade_sums()).join(repeats, on)


# Repeats cancel out of every quotient, so only totals carry them.
def _volume() -> Column:
    return F.col("shares_sum") * F.col("repeats")


def _count() -> Column:
    return F.col("n") * F.col("repeats")


def _vwap() -> Column:
    return measures.vwap(F.col("notional_sum"), F.col("shares_sum"))


def _mean() -> Column:
    return measures.mean_price(F.col("ticks_sum"), F.col("priced"))


def bar_columns() -> list[Column]:
    """Measures of a bar from `trade_sums` and `repeats`."""
    return [
        _volume().alias("volume"),
        _vwap().alias("vwap"),
        _mean().alias("avg_price"),
        _count().alias("trade_count"),
    ]


def vwap_by_stock(trades: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    """Volume-weighted price and volume per (stock, category), largest volume first."""
    return (
        _by_category(trades, directory, ["stock"])
        .select(*by_day(trades, "stock", "market_cat"), _vwap().alias("vwap"), _volume().alias("total_volume"))
        .orderBy(F.desc("total_volume"), "stock", "market_cat")
    )


def minute_bars(
    trades: DataFrame,
    directory: DataFrame | None = None,
    bar_ns: int = MINUTE_NS,
    mode: str = "floor",
    ordered: bool = True,
) -> DataFrame:
    """Volume, VWAP, mean price and trade count per (stock, bar, category)."""
    bars = _by_category(
        rows.with_bucket(trades, bar_ns, mode), directory, ["stock", "minute_bucket"]
    ).select(*by_day(trades, "stock", "minute_bucket", "market_cat"), *bar_columns())
    return bars.orderBy(*by_day(trades, "stock", "minute_bucket", "market_cat")) if ordered else bars


def stock_summary(trades: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    """Volume, mean price and trade count per (stock, category), largest volume first."""
    return (
        _by_category(trades, directory, ["stock"])
        .select(
            *by_day(trades, "stock", "market_cat"),
            _volume().alias("total_volume"),
            _mean().alias("avg_price"),
            _count().alias("trade_count"),
        )
        .orderBy(F.desc("total_volume"), "stock", "market_cat")
    )


def ohlc_candles(
    trades: DataFrame,
    bar_ns: int = MINUTE_NS,
    mode: str = "floor",
) -> DataFrame:
    """Low, high, open, close, VWAP and volume per (stock, bar).

    Open and close follow (time, place in file), not the order of the scan.
    """
    return (
        rows.with_bucket(trades, bar_ns, mode)
        .groupBy(*by_day(trades, "stock", "minute_bucket"))
        .agg(*candle_columns())
    )


def top_by_volume(trades: DataFrame, k: int = 10) -> DataFrame:
    """The k stocks with the largest volume; equal volumes in order of name."""
    return (
        rows.named_keys_only(trades)
        .groupBy("stock")
        .agg(F.sum("shares").alias("vol"))
        .orderBy(F.desc("vol"), "stock")
        .limit(k)
    )


def tickers(trades: DataFrame) -> DataFrame:
    """Distinct stocks in order of name."""
    return trades.select("stock").dropna().distinct().orderBy("stock")


def stock_totals(bars: DataFrame) -> DataFrame:
    """Per stock: volume, trades and mean volume of a bar."""
    return bars.groupBy(*by_day(bars, "stock")).agg(
        F.sum("volume").alias("total_volume"),
        F.sum("trade_count").alias("trade_count"),
        measures.ratio(F.sum("volume"), F.count("volume")).alias("avg_bar_volume"),
    )


def legacy_stock_summary(legacy: DataFrame) -> DataFrame:
    """Volume, mean price and row count per (stock, category) of the legacy table.

    Rows with a NULL key are left out; `trade_count` counts rows, priced or not.
    """
    return (
        legacy.dropna(subset=["stock", "market_cat"])
        .groupBy("stock", "market_cat")
        .agg(
            F.coalesce(F.sum("volume"), F.lit(0)).alias("total_volume"),
            F.avg("price").alias("avg_price"),
            F.count(F.lit(1)).alias("trade_count"),
        )
    )
