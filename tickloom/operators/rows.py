"""Row selection: message kinds, columns, keys, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import times
from tickloom.operators.slices import numbered as numbered_rows

PLACE_BITS = 40


def of_type(messages: DataFrame, kind: str) -> DataFrame:
    """Messages of one type; prunes the `msg_type` partition of a landed table."""
    return messages.filter(F.col("msg_type") == kind)


def trades(messages: DataFrame) -> DataFrame:
    return of_type(messages, "P").drop("market_cat", "order_ref")


def add_orders(messages: DataFrame) -> DataFrame:
    return of_type(messages, "A").drop("market_cat")


def directory(messages: DataFrame) -> DataFrame:
    """Distinct (locate, stock, category); several rows per stock are possible."""
    columns = times.by_day(messages, "stock_locate", "stock", "market_cat")
    return of_type(messages, "R").select(*columns).distinct()


def number_files(messages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Make `seq` a place in the whole tape: the file's number, then the offset in it.

    Offsets repeat from file to file. With the files numbered by path, (ts_ns,
    seq) is a total order, which open, close, newest quote and VWAP change need.
    A file may reach 2^40 bytes, a tape 2^23 files; more is an error. `files(path)` are the tape's files where they
    are known already; numbers are dense and start at 0.
    """
    paths = (messages if files is None else files).select("path").distinct()
    numbered = numbered_rows(paths, ["path"], "__file")
    fits = F.col("seq").between(0, (1 << PLACE_BITS) - 1) & (F.col("__file") < 1 << (63 - PLACE_BITS))
    too_large = F.raise_error(F.format_string("file %s or offset %s is too large", "__file", "seq")).cast("bigint")
    place = F.when(fits, F.shiftleft("__file", PLACE_BITS).bitwiseOR(F.col("seq"))).otherwise(too_large)
    return messages.join(numbered, "path").withColumn("seq", place).drop("__file")


def trade_columns(messages: DataFrame) -> DataFrame:
    """The five columns of the first tape version."""
    return of_type(messages, "P").select(
        F.col("stock_locate").cast("bigint").alias("stock_locate"),
        F.col("ts_ns").alias("timestamp"),
        "shares",
        "stock",
        "price",
    )


def of_stock(df: DataFrame, stock: str) -> DataFrame:
    """Rows of one stock; the value never becomes part of a query text."""
    return df.filter(F.col("stock") == F.lit(stock))


def in_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is one of a few constants."""
    return df.filter(F.col(column).isin(list(values)))


def with_times(df: DataFrame, bar_ns: int = times.MINUTE_NS, mode: str = "floor") -> DataFrame:
    """All derived time columns of `ts_ns`."""
    ts = F.col("ts_ns")
    return df.withColumns(
        {
            "readable_time": times.readable_time(ts),
            "hour": times.hour_of_day(ts),
            "timestamp_sec": times.seconds(ts),
            "minute_bucket": times.bucket(ts, bar_ns, mode),
        }
    )


def with_bucket(df: DataFrame, bar_ns: int = times.MINUTE_NS, mode: str = "floor") -> DataFrame:
    return df.withColumn("minute_bucket", times.bucket(F.col("ts_ns"), bar_ns, mode))


def landed(messages: DataFrame, trade_date: str | None = None) -> DataFrame:
    """Messages with the columns of the landed table.

    A feed's clock counts from midnight and its files carry no date, so the date
    is given, as text or by a `trade_date` column of the messages; it is never guessed.
    """
    day = F.col("trade_date") if trade_date is None else F.lit(trade_date).cast("date")
    midnight = F.unix_micros(day.cast("timestamp"))
    ts = F.col("ts_ns")
    return messages.withColumns(
        {
            "timestamp": ts,
            "readable_time": F.timestamp_micros(midnight + times.whole(ts, 1000)),
            "hour": times.hour_of_day(ts),
            "trade_date": day,
        }
    )


def named_keys_only(df: DataFrame, column: str = "stock") -> DataFrame:
    """Drop NULL and empty keys."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def row_counts(messages: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Rows of each kind, and whether there are none: a kind that never occurs has a row too."""
    wanted = messages.sparkSession.createDataFrame([(k,) for k in kinds], "msg_type string")
    counted = messages.groupBy("msg_type").agg(F.count(F.lit(1)).alias("rows"))
    return wanted.join(counted, "msg_type", "left").select(
        "msg_type",
        F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        F.col("rows").isNull().alias("is_empty"),
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """`df`, or ValueError when it is empty; reads one row."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df
