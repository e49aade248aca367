"""Features and labels for short-term price direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.times import by_day, minute_start
from tickloom.operators import joins, rows, signals
from tickloom.operators.bars import top_by_volume
from tickloom.session import materialise

FEATURES = ("OBI", "Rolling_Volatility", "Trade_Count_Per_Min", "VWAP_Change")
LABEL = "price_direction"


def build_features(
    messages: DataFrame,
    top: int = 5,
    bar_s: int = 60,
    window_s: int = signals.FEATURE_WINDOW_S,
    horizon_s: int = signals.LABEL_HORIZON_S,
    obi_lag: int = 0,
) -> DataFrame:
    """One row per trade of the `top` stocks by volume, complete rows only.

    A trade gets the imbalance of its own bar, later orders of the bar included;
    `obi_lag=1` takes the bar before, which a model could know in time. Imbalance
    and windows are joined per second, so trades are shuffled once.
    """
    leaders = top_by_volume(rows.trades(messages), top)
    # Read three times below: trades for the windows and for the rows, orders for the imbalance.
    kept = rows.in_values(messages, "msg_type", ["P", "A"])
    kept = materialise(joins.keep_top(kept, leaders), "leaders")
    trades, adds = rows.trades(kept), rows.add_orders(kept)

    obi = signals.order_book_imbalance_eps(adds, bar_s)
    bar = minute_start(F.col("timestamp_sec"), bar_s) - F.lit(obi_lag * bar_s)
    stats = signals.second_stats(trades, window_s, horizon_s).withColumn("minute_bucket", bar)
    stats = joins.attach_imbalance(stats, obi)
    return rows.complete_rows(
        signals.with_second_stats(trades, stats).select(
            *by_day(messages, "stock", "timestamp_sec"), *FEATURES, LABEL
        )
    )
