"""Joins of the tape: directory, imbalance, newest quote, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import measures
from tickloom.functions.times import SLICE_NS, by_day
from tickloom.operators.slices import last_known

def dimension_keys(facts: DataFrame, dimension: DataFrame) -> list[str]:
    """Stock, and the trade date where both sides have one."""
    return by_day(dimension, "stock") if "trade_date" in facts.columns else ["stock"]


def join_dimension(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join a large table with a smaller one.

    Spark decides from its size estimates, and again at run time, whether the
    dimension is broadcast; beyond the limit both sides are shuffled on the key
    and adaptive execution splits the partitions of hot keys. Building the join
    starts no job. `salts` spreads every key over that many tasks with a copy of
    the dimension for each: for hot facts where adaptive execution is off. The
    salt is a hash of fact columns, so a re-run task repeats it.
    """
    if not salts:
        return facts.join(dimension, list(on), how)
    salt = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        facts.withColumn("__salt", salt)
        .join(dimension.withColumn("__salt", copies), [*on, "__salt"], how)
        .drop("__salt")
    )


def enrich_trades(
    trades: DataFrame, directory: DataFrame, salts: int | None = None
) -> DataFrame:
    """Trades with their directory row.

    Inner join on `stock`, of the same day where both sides have a date: a trade
    without a directory row is dropped, and a stock with several directory rows
    repeats its trades. The locate code comes from the directory, as in the
    directory table.
    """
    facts = trades.drop("stock_locate", "market_cat")
    return join_dimension(facts, directory, dimension_keys(facts, directory), salts=salts)


def directory_latest(messages: DataFrame) -> DataFrame:
    """One directory row per stock (and day): the newest, for a join without fan-out.

    The newest place is found by hashing and joined back: a string next to it in
    the aggregate would sort all rows.
    """
    rows = messages.filter("msg_type = 'R'").withColumn(
        "__at", measures.order_key(F.col("ts_ns"), F.col("seq"))
    )
    keys = by_day(messages, "stock")
    newest = rows.groupBy(*keys).agg(F.max("__at").alias("__at"))
    columns = by_day(messages, "stock_locate", "stock", "market_cat")
    return rows.join(newest, [*keys, "__at"]).select(*columns).distinct()


def attach_imbalance(
    trades: DataFrame, imbalance: DataFrame, keys: Sequence[str] = ("stock", "minute_bucket")
) -> DataFrame:
    """Left join with the imbalance of the same stock and bar; no bar gives 0.0."""
    keys = by_day(trades, *keys)
    obi = imbalance.select(*keys, "OBI")
    return trades.join(obi, list(keys), "left").fillna({"OBI": 0.0})


def keep_top(df: DataFrame, top: DataFrame, on: str = "stock") -> DataFrame:
    """Rows whose key is in a top-k result.

    The limit bounds the size Spark estimates for it: a usual k is broadcast
    without a hint, a huge one is not.
    """
    return df.join(top.select(on), on, "left_semi")


def last_quote(
    messages: DataFrame,
    keys: Sequence[str] = ("stock_locate",),
    slice_ns: int = SLICE_NS,
    by_side: bool = False,
) -> DataFrame:
    """Add `last_a_price`: the newest add-order price up to each A or P row.

    Equal times are ordered by place in the file, so an add order counts for a
    trade of the same nanosecond only when it came first. `by_side=True` keeps
    one stream per side instead of one for both.
    """
    return last_known(
        messages.filter(F.col("msg_type").isin("A", "P")),
        by_day(messages, *keys, *(["side"] if by_side else [])),
        "ts_ns",
        "seq",
        F.when(F.col("msg_type") == "A", F.col("price")),
        slice_ns,
        "last_a_price",
    )


def impact(price: Column, quote: Column) -> Column:
    return price - quote


def market_impact(
    messages: DataFrame,
    columns: Sequence[str] = ("stock_locate", "ts_ns", "price"),
    **options,
) -> DataFrame:
    """Per trade the distance of its price from the newest add-order price."""
    return (
        last_quote(messages, **options)
        .filter("msg_type = 'P'")
        .withColumn("market_impact", impact(F.col("price"), F.col("last_a_price")))
        .select(*by_day(messages, *columns), "last_a_price", "market_impact")
    )
