"""Fixed schemas of the tape tables."""

from __future__ import annotations

from pyspark.sql.types import (
    BinaryType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _table(*columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns])


# One row per length-prefixed frame; `seq` is the byte offset of the frame's
# length prefix, so it is unique and ascending inside a file; a landed tape has
# the file's number above it (`rows.number_files`), which makes it unique in the tape.
FRAMES = _table(("path", StringType()), ("seq", LongType()), ("payload", BinaryType()))

# One wide row per decoded message. Prices are whole ticks of 1/10000, which
# makes sums exact; `price` is the same number in currency units.
MESSAGES = _table(
    ("path", StringType()),
    ("seq", LongType()),
    ("msg_type", StringType()),
    ("stock_locate", IntegerType()),
    ("ts_ns", LongType()),
    ("stock", StringType()),
    ("shares", LongType()),
    ("price_ticks", LongType()),
    ("price", DoubleType()),
    ("order_ref", LongType()),
    ("side", StringType()),
    ("market_cat", StringType()),
)

# A file to be read.
LISTED = _table(("path", StringType()), ("length", LongType()))

# Frames that are left out, with the reason.
REJECTED = StructType(FRAMES.fields + _table(("reason", StringType())).fields)

# The landed form adds the time columns. Date, type and hour are folders.
_TIMES = (
    ("timestamp", LongType()),
    ("readable_time", TimestampType()),
    ("hour", IntegerType()),
    ("trade_date", DateType()),
)
LANDED_MESSAGES = StructType(MESSAGES.fields + _table(*_TIMES).fields)

DIRECTORY = _table(
    ("stock_locate", IntegerType()), ("stock", StringType()), ("market_cat", StringType())
)

ENRICHED_TRADES = _table(
    ("path", StringType()),
    ("seq", LongType()),
    ("stock", StringType()),
    ("ts_ns", LongType()),
    ("shares", LongType()),
    ("price_ticks", LongType()),
    ("price", DoubleType()),
    ("msg_type", StringType()),
    ("stock_locate", IntegerType()),
    ("market_cat", StringType()),
    *_TIMES,
)

_DAY = (("trade_date", DateType()),)

BAR_SUMMARY = _table(
    ("stock", StringType()),
    ("minute_bucket", LongType()),
    ("market_cat", StringType()),
    ("volume", LongType()),
    ("vwap", DoubleType()),
    ("avg_price", DoubleType()),
    ("trade_count", LongType()),
)

STOCK_SUMMARY = _table(
    ("stock", StringType()),
    ("market_cat", StringType()),
    ("total_volume", LongType()),
    ("avg_price", DoubleType()),
    ("trade_count", LongType()),
)

ORDER_BOOK_IMBALANCE = _table(
    ("stock", StringType()),
    ("minute_bucket", LongType()),
    ("Buy_Vol", LongType()),
    ("Sell_Vol", LongType()),
    ("OBI", DoubleType()),
)

VWAP = _table(
    *_DAY,
    ("stock", StringType()),
    ("market_cat", StringType()),
    ("vwap", DoubleType()),
    ("total_volume", LongType()),
)

# The same tables of a tape with dates.
DATED_BAR_SUMMARY = StructType(_table(*_DAY).fields + BAR_SUMMARY.fields)
DATED_STOCK_SUMMARY = StructType(_table(*_DAY).fields + STOCK_SUMMARY.fields)
DATED_ORDER_BOOK_IMBALANCE = StructType(_table(*_DAY).fields + ORDER_BOOK_IMBALANCE.fields)
