"""Read queries over the landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.functions.times import MINUTE_NS
from tickloom.operators import bars, reports, rows


def _one(df: DataFrame, stock: str | None) -> DataFrame:
    return df if stock is None else rows.of_stock(df, stock)


def q_tickers(trades: DataFrame) -> DataFrame:
    """All traded stocks in order of name."""
    return bars.tickers(trades)


def q_summary(enriched: DataFrame) -> DataFrame:
    """Volume, mean price and trades per (stock, category), largest volume first."""
    return bars.stock_summary(enriched)


def q_candles(
    trades: DataFrame, stock: str | None = None, bar_ns: int = MINUTE_NS, mode: str = "floor"
) -> DataFrame:
    """Candles of one stock, or of all, in order of time."""
    return bars.ohlc_candles(_one(trades, stock), bar_ns, mode).orderBy("stock", "minute_bucket")


def q_obi_series(imbalance: DataFrame, stock: str | None = None) -> DataFrame:
    """Imbalance and its two volumes in order of time."""
    return (
        _one(imbalance, stock)
        .select("stock", "minute_bucket", "OBI", "Buy_Vol", "Sell_Vol")
        .orderBy("stock", "minute_bucket")
    )


def q_sentiment(trades: DataFrame, imbalance: DataFrame, stock: str | None = None) -> DataFrame:
    """Sentiment of one stock, or of all."""
    return reports.sentiment(_one(trades, stock), _one(imbalance, stock))
