"""Bars as sums that can be added up: of one run, of several, of all.

A kind of bar has three steps: the sums of new rows, the same sums added up over
runs, and the columns a reader wants. Adding up is exact and does not depend on
the order or number of runs, so the last step gives what a batch over all rows
gives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import measures
from tickloom.functions.times import MINUTE_NS, by_day
from tickloom.operators import bars, joins, rows
from tickloom.operators.signals import side_volumes

BAR = ("stock", "minute_bucket")


@dataclass(frozen=True)
class Kind:
    """`first` sums rows, `again` sums sums; both keep the column names."""

    name: str
    rows: Callable[[DataFrame], DataFrame]
    first: Callable[[], list[Column]]
    again: Callable[[], list[Column]]
    columns: str
    finish: Callable[..., DataFrame]

    def sums(self, landed: DataFrame, bar_ns: int = MINUTE_NS, mode: str = "floor") -> DataFrame:
        chosen = rows.with_bucket(self.rows(landed), bar_ns, mode)
        return chosen.groupBy(*by_day(chosen, *BAR)).agg(*self.first())

    def added(self, sums: DataFrame) -> DataFrame:
        return sums.groupBy(*by_day(sums, *BAR)).agg(*self.again())

    def schema(self, dated: bool) -> str:
        return ("trade_date date, " if dated else "") + "stock string, minute_bucket bigint, " + self.columns


def _again(names: str) -> Callable[[], list[Column]]:
    return lambda: [F.sum(name).alias(name) for name in names.split()]


def _bars(sums: DataFrame, directory: DataFrame) -> DataFrame:
    """The bars of `bars.minute_bars`: the category joins the sums."""
    on = joins.dimension_keys(sums, directory)
    repeats = directory.groupBy(*on, "market_cat").agg(F.count(F.lit(1)).alias("repeats"))
    return sums.join(repeats, on).select(*by_day(sums, *BAR, "market_cat"), *bars.bar_columns())


def _candle_sums() -> list[Column]:
    ticks, shares = F.col("price_ticks"), F.col("shares")
    at = measures.order_key(F.col("ts_ns"), F.col("seq"))
    return [
        F.min(ticks).alias("low"),
        F.max(ticks).alias("high"),
        F.min_by(ticks, at).alias("open"),
        F.min(at).alias("open_at"),
        F.max_by(ticks, at).alias("close"),
        F.max(at).alias("close_at"),
        F.sum(measures.notional(ticks, shares)).alias("notional_sum"),
        F.sum(shares).alias("shares_sum"),
    ]


def _candles_again() -> list[Column]:
    return [
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min_by("open", "open_at").alias("open"),
        F.min("open_at").alias("open_at"),
        F.max_by("close", "close_at").alias("close"),
        F.max("close_at").alias("close_at"),
        F.sum("notional_sum").alias("notional_sum"),
        F.sum("shares_sum").alias("shares_sum"),
    ]


def _candles(sums: DataFrame) -> DataFrame:
    return sums.select(
        *by_day(sums, *BAR),
        *[measures.price(F.col(c)).alias(c) for c in ("low", "high", "open", "close")],
        measures.vwap(F.col("notional_sum"), F.col("shares_sum")).alias("vwap"),
        F.col("shares_sum").alias("volume"),
    )


def _imbalance(sums: DataFrame) -> DataFrame:
    return sums.withColumn("OBI", measures.imbalance(F.col("Buy_Vol"), F.col("Sell_Vol")))


BARS = Kind(
    "bars",
    rows.trades,
    bars.trade_sums,
    _again("shares_sum notional_sum ticks_sum priced n"),
    "shares_sum bigint, notional_sum decimal(38,0), ticks_sum bigint, priced bigint, n bigint",
    _bars,
)
IMBALANCE = Kind(
    "imbalance", rows.add_orders, side_volumes, _again("Buy_Vol Sell_Vol"), "Buy_Vol bigint, Sell_Vol bigint", _imbalance
)
CANDLES = Kind(
    "candles",
    rows.trades,
    _candle_sums,
    _candles_again,
    "low bigint, high bigint, open bigint, open_at decimal(38,0), close bigint, close_at decimal(38,0), "
    "notional_sum decimal(38,0), shares_sum bigint",
    _candles,
)
