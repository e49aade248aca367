"""Arithmetic on prices and volumes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The price unit of the feed.
TICKS_PER_UNIT = 10000


def price(ticks: Column) -> Column:
    return ticks / F.lit(float(TICKS_PER_UNIT))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def notional(ticks: Column, shares: Column) -> Column:
    """Ticks times shares. Two unsigned 32 bit numbers do not fit a BIGINT product."""
    return ticks.cast("decimal(10,0)") * shares.cast("decimal(10,0)")


def order_key(ts: Column, seq: Column) -> Column:
    """(ts, seq) of non-negative integers as one number in the same order.

    Aggregates over a number hash; over a struct they would sort all rows first.
    """
    shift = F.lit(Decimal(10**19))
    return (ts.cast("decimal(19,0)") * shift + seq.cast("decimal(19,0)")).cast("decimal(38,0)")


def squared(ticks: Column) -> Column:
    return ticks.cast("decimal(10,0)") * ticks.cast("decimal(10,0)")


def vwap(notional_sum: Column, share_sum: Column) -> Column:
    return ratio(notional_sum, share_sum) / F.lit(float(TICKS_PER_UNIT))


def mean_price(tick_sum: Column, n: Column) -> Column:
    return ratio(tick_sum, n) / F.lit(float(TICKS_PER_UNIT))


def sample_stddev(n: Column, tick_sum: Column, square_sum: Column) -> Column:
    """Sample standard deviation in currency units from exact integer sums.

    With q = whole mean and r = remainder, sum(x^2) - (sum x)^2 / n equals
    (sum(x^2) - q * (sum x + r)) - r^2 / n. The bracket is exact, so nothing is
    lost when a small spread sits on a large price. NULL below two rows.
    """
    q = F.call_function("div", tick_sum, n)
    r = tick_sum - q * n
    exact = square_sum - q.cast("decimal(11,0)") * (tick_sum + r).cast("decimal(20,0)")
    spread = exact.cast("double") - r.cast("double") * r.cast("double") / n
    variance = F.greatest(spread, F.lit(0.0)) / (n - 1)
    return F.when(n > 1, F.sqrt(variance) / F.lit(float(TICKS_PER_UNIT)))


def imbalance(buy: Column, sell: Column) -> Column:
    """(B - S) / (B + S) in [-1, 1]; NULL for an empty pair."""
    return ratio(buy - sell, buy + sell)


def imbalance_eps(buy: Column, sell: Column, eps: float = 1e-9) -> Column:
    """As `imbalance`, 0.0 instead of NULL for an empty pair."""
    return (buy - sell).cast("double") / ((buy + sell).cast("double") + F.lit(eps))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
