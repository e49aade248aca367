"""Time columns. All inputs are whole nanoseconds or whole seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND_NS = 1_000_000_000
MINUTE_NS = 60 * SECOND_NS
HOUR_NS = 60 * MINUTE_NS
DAY_NS = 24 * HOUR_NS

# Default slice of windows over hot stocks: some thousand slices a day.
SLICE_NS = 10 * SECOND_NS


def by_day(df: DataFrame, *keys: str) -> list[str]:
    """Grouping keys of a tape: with the trade date first where the tape has one.

    Times count from midnight, so days of one tape are told apart by this only.
    """
    return [c for c in ("trade_date",) if c in df.columns] + list(keys)


def whole(numerator: Column, divisor: int) -> Column:
    """Integer division; never passes through a double."""
    return F.call_function("div", numerator, F.lit(divisor).cast("bigint"))


def bucket(ts: Column, width: int, mode: str = "floor") -> Column:
    """Number of the bar that holds `ts`.

    `floor` is the default everywhere. `round` gives the nearest bar, halves to
    even: the rule of the candle query in its original form.
    """
    if mode == "floor":
        return whole(ts, width)
    if mode == "round":
        return F.rint(ts / F.lit(width)).cast("bigint")
    raise ValueError(f"unknown bucket mode {mode!r}")


def slice_start(ts: Column, width: int) -> Column:
    """Start of the `width`-wide slice that holds `ts`, also below zero."""
    return ts - F.pmod(ts, F.lit(width).cast("bigint"))


def seconds(ts_ns: Column) -> Column:
    return whole(ts_ns, SECOND_NS)


def minute_start(ts_sec: Column, width: int = 60) -> Column:
    """First second of the bar that holds `ts_sec`."""
    return whole(ts_sec, width) * F.lit(width)


def hour_of_day(ts_ns: Column) -> Column:
    """Hour of the tape's own day; independent of the session time zone."""
    return whole(F.pmod(ts_ns, F.lit(DAY_NS)), HOUR_NS).cast("int")


def readable_time(ts_ns: Column) -> Column:
    """Nanoseconds as a timestamp (microsecond precision)."""
    return F.timestamp_micros(whole(ts_ns, 1000))


def chart_time(minute_bucket: Column, bar_seconds: int = 60) -> Column:
    """Bar number as seconds, the x axis of the charts."""
    return minute_bucket * F.lit(bar_seconds)
