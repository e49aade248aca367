"""Frames to typed messages, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import binary
from tickloom.functions.measures import price

# The byte layout of the three decoded message kinds. A payload
# shorter than the last byte used is rejected.
LOCATE = (1, 2)
TIMESTAMP = (5, 6)
DIRECTORY_STOCK = (11, 8)
DIRECTORY_CATEGORY = 19
DIRECTORY_LENGTH = 20
ORDER_REF = (11, 8)
SIDE = 19
SHARES = (20, 4)
STOCK = (24, 8)
PRICE = (32, 4)
ORDER_LENGTH = 36


def _is_type(payload: Column, *kinds: str) -> Column:
    first = F.substring(payload, 1, 1)
    return first.isin(*[bytearray(kind, "ascii") for kind in kinds])


def _accepted(payload: Column) -> Column:
    size = F.octet_length(payload)
    directory = (
        _is_type(payload, "R")
        & (size >= DIRECTORY_LENGTH)
        & binary.is_text(payload, *DIRECTORY_STOCK)
    )
    order = _is_type(payload, "A", "P") & (size >= ORDER_LENGTH) & binary.is_text(payload, *STOCK)
    return directory | order


def decode_messages(frames: DataFrame) -> DataFrame:
    """Directory (R), add-order (A) and trade (P) frames as one wide table.

    Columns of other kinds are NULL. Other types and undecodable frames are left
    out; `rejected_frames` shows them.
    """
    p = F.col("payload")
    directory, add = _is_type(p, "R"), _is_type(p, "A")
    stock = F.when(directory, binary.text(p, *DIRECTORY_STOCK)).otherwise(
        binary.text(p, *STOCK)
    )
    kind = F.when(directory, "R").when(add, "A").otherwise("P")
    return frames.filter(_accepted(p)).select(*_fields(p, directory, add, kind, stock))


def decode_tagged(frames: DataFrame) -> DataFrame:
    """The same for frames that have their `msg_type` and `stock` beside the payload.

    Both stay plain columns, so filters on them pass to the source.
    """
    kind = F.col("msg_type")
    return frames.select(*_fields(F.col("payload"), kind == "R", kind == "A", kind, F.col("stock")))


def _fields(p: Column, directory: Column, add: Column, kind: Column, stock: Column) -> list[Column | str]:
    ticks = F.when(~directory, binary.unsigned(p, *PRICE))
    return [
        "path",
        "seq",
        kind.alias("msg_type"),
        binary.unsigned(p, *LOCATE).cast("int").alias("stock_locate"),
        binary.unsigned(p, *TIMESTAMP).alias("ts_ns"),
        stock.alias("stock"),
        F.when(~directory, binary.unsigned(p, *SHARES)).alias("shares"),
        ticks.alias("price_ticks"),
        price(ticks).alias("price"),
        F.when(add, binary.unsigned(p, *ORDER_REF)).alias("order_ref"),
        F.when(~directory, binary.char(p, SIDE)).alias("side"),
        F.when(directory, binary.char(p, DIRECTORY_CATEGORY)).alias("market_cat"),
    ]


def rejected_frames(frames: DataFrame) -> DataFrame:
    """Frames `decode_messages` leaves out, with the reason."""
    p, size = F.col("payload"), F.octet_length("payload")
    known = _is_type(p, "R", "A", "P")
    needed = F.when(_is_type(p, "R"), F.lit(DIRECTORY_LENGTH)).otherwise(F.lit(ORDER_LENGTH))
    reason = (
        F.when(size == 0, "empty")
        .when(~known, "other type")
        .when(size < needed, "too short")
        .otherwise("bad text")
    )
    return frames.filter(~_accepted(p)).select("path", "seq", "payload", reason.alias("reason"))
