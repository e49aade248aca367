"""Display strings of the report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols and histogram colours shown to the reader.
UP = "▲"
DOWN = "▼"
FLAT = "●"
POSITIVE_COLOUR = "rgba(0, 230, 118, 0.5)"
NEGATIVE_COLOUR = "rgba(255, 59, 48, 0.5)"


def _fixed(value: Column, places: int) -> Column:
    # format_number rounds the exact double, halves to even, like printf in C;
    # format_string would round its shortest decimal form.
    return F.translate(F.format_number(value.cast("double"), places), ",", "")


def dollars(value: Column, places: int = 2) -> Column:
    return F.concat(F.lit("$"), _fixed(value, places))


def grouped(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(value, 0)


def millions(value: Column) -> Column:
    return F.concat(_fixed(value.cast("double") / F.lit(1e6), 1), F.lit("M"))


def percent(value: Column) -> Column:
    return F.concat(_fixed(value, 2), F.lit("%"))


def signed(value: Column, places: int = 4) -> Column:
    """A leading plus for positive numbers only."""
    return F.when(value > 0, F.concat(F.lit("+"), _fixed(value, places))).otherwise(
        _fixed(value, places)
    )


def upper_ticker(stock: Column) -> Column:
    return F.upper(stock)


def arrow(change: Column) -> Column:
    """Tick direction; no earlier row (NULL) counts as flat."""
    return (
        F.when(change > 0, F.lit(UP)).when(change < 0, F.lit(DOWN)).otherwise(F.lit(FLAT))
    )


def trend(change: Column) -> Column:
    """Session direction: zero counts as up."""
    return F.when(change >= 0, F.lit(UP)).otherwise(F.lit(DOWN))
