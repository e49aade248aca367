"""Order-book imbalance and rolling trade statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import measures, times
from tickloom.operators import rows
from tickloom.operators.bars import top_by_volume
from tickloom.operators.joins import keep_top
from tickloom.operators.slices import rolling_sums

# Frame widths of the signals.
VOLATILITY_WINDOW_NS = 300 * times.SECOND_NS
SLICE_WINDOWS = 4
FEATURE_WINDOW_S = 60
LABEL_HORIZON_S = 30


def side_volumes() -> list[Column]:
    """Added buy and sell volume; other sides count for neither."""

    def volume(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("shares")).otherwise(F.lit(0)))

    return [volume("B").alias("Buy_Vol"), volume("S").alias("Sell_Vol")]


def order_book_imbalance(adds: DataFrame, bar_ns: int = times.MINUTE_NS) -> DataFrame:
    """Added buy and sell volume per (stock, bar) and their imbalance."""
    return (
        rows.with_bucket(adds, bar_ns)
        .groupBy(*times.by_day(adds, "stock", "minute_bucket"))
        .agg(*side_volumes())
        .withColumn("OBI", measures.imbalance(F.col("Buy_Vol"), F.col("Sell_Vol")))
    )


def order_book_imbalance_eps(adds: DataFrame, bar_s: int = 60, eps: float = 1e-9) -> DataFrame:
    """The same per bar start in seconds; an empty bar gives 0.0, not NULL."""
    start = times.minute_start(times.seconds(F.col("ts_ns")), bar_s)
    return (
        adds.withColumn("minute_bucket", start)
        .groupBy(*times.by_day(adds, "stock", "minute_bucket"))
        .agg(*side_volumes())
        .withColumn("OBI", measures.imbalance_eps(F.col("Buy_Vol"), F.col("Sell_Vol"), eps))
    )


def rolling_volatility(
    trades: DataFrame,
    window_ns: int = VOLATILITY_WINDOW_NS,
    top: int | None = 10,
    keys: Sequence[str] = ("stock",),
    slice_ns: int | None = None,
) -> DataFrame:
    """Sample stddev of price over [ts - window, ts] for the stocks of largest volume.

    `top=None` keeps all stocks. The first trade of a window has no stddev. Slices
    are four windows wide unless told otherwise.
    """
    kept = trades if top is None else keep_top(trades, top_by_volume(trades, top))
    ticks = F.col("price_ticks")
    sums = rolling_sums(
        kept,
        times.by_day(kept, *keys),
        "ts_ns",
        window_ns,
        {
            "__n": F.when(ticks.isNotNull(), 1).cast("bigint"),
            "__s": ticks,
            "__ss": measures.squared(ticks),
        },
        slice_ns or SLICE_WINDOWS * window_ns,
    )
    spread = measures.sample_stddev(F.col("__n"), F.col("__s"), F.col("__ss"))
    return sums.withColumn("volatility", spread).drop("__n", "__s", "__ss")


def second_stats(
    trades: DataFrame,
    window_s: int = FEATURE_WINDOW_S,
    horizon_s: int = LABEL_HORIZON_S,
    keys: Sequence[str] = ("stock",),
) -> DataFrame:
    """Rolling statistics per (key, second).

    All frames are ranges of whole seconds, so every trade of one second has the
    same frame. Trades are therefore summed per second before any window. A feed
    day has 86,400 seconds, which bounds a window partition whatever share of
    the trades its stock holds; days are keys of their own.

    Columns: Trade_Count_Per_Min, Rolling_Volatility, VWAP, VWAP_before (of the
    stock's previous second), Future_Max_Price, first_trade (order key of the
    second's first trade).
    """
    keys = times.by_day(trades, *keys)
    ticks, shares = F.col("price_ticks"), F.col("shares")
    per_second = (
        trades.withColumn("timestamp_sec", times.seconds(F.col("ts_ns")))
        .groupBy(*keys, "timestamp_sec")
        .agg(
            F.count(ticks).alias("n"),
            F.sum(ticks).alias("s"),
            F.sum(measures.squared(ticks)).alias("ss"),
            F.sum(measures.notional(ticks, shares)).alias("pq"),
            F.sum(shares).alias("q"),
            F.max(ticks).alias("high"),
            F.min(measures.order_key(F.col("ts_ns"), F.col("seq"))).alias("first_trade"),
        )
    )
    in_time = Window.partitionBy(*keys).orderBy("timestamp_sec")
    back, ahead = in_time.rangeBetween(-window_s, 0), in_time.rangeBetween(1, horizon_s)

    def rolled(column: str) -> Column:
        return F.sum(column).over(back)

    return (
        per_second.select(
            *keys,
            "timestamp_sec",
            "first_trade",
            rolled("n").alias("Trade_Count_Per_Min"),
            measures.sample_stddev(rolled("n"), rolled("s"), rolled("ss")).alias(
                "Rolling_Volatility"
            ),
            measures.vwap(rolled("pq"), rolled("q")).alias("VWAP"),
            measures.price(F.max("high").over(ahead)).alias("Future_Max_Price"),
        )
        .withColumn("VWAP_before", F.lag("VWAP").over(in_time))
    )


def with_second_stats(
    trades: DataFrame, stats: DataFrame, keys: Sequence[str] = ("stock",)
) -> DataFrame:
    """Trades with the statistics of their second, the VWAP change and the label.

    `VWAP_prev` is the VWAP of the trade before, by (time, place in file): inside
    a second that is the second's own VWAP, for its first trade that of the
    stock's previous second.
    """
    opening = measures.order_key(F.col("ts_ns"), F.col("seq")) == F.col("first_trade")
    return (
        trades.withColumn("timestamp_sec", times.seconds(F.col("ts_ns")))
        .join(stats, times.by_day(trades, *keys, "timestamp_sec"))
        .withColumn(
            "VWAP_prev", F.when(opening, F.col("VWAP_before")).otherwise(F.col("VWAP"))
        )
        .withColumn("VWAP_Change", F.col("VWAP") - F.col("VWAP_prev"))
        .withColumn(
            "price_direction", price_direction(F.col("Future_Max_Price"), F.col("price"))
        )
        .drop("first_trade", "VWAP_before")
    )


def rolling_trade_stats(
    trades: DataFrame,
    window_s: int = FEATURE_WINDOW_S,
    horizon_s: int = LABEL_HORIZON_S,
    keys: Sequence[str] = ("stock",),
) -> DataFrame:
    """Trades with rolling volatility, count, VWAP, VWAP change, future high and label."""
    return with_second_stats(trades, second_stats(trades, window_s, horizon_s, keys), keys)


def price_direction(future_max: Column, price: Column) -> Column:
    """1.0 when a later price in the horizon is higher; no later trade counts as 0.0."""
    return F.when(future_max > price, F.lit(1.0)).otherwise(F.lit(0.0))
