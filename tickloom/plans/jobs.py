"""The batch jobs: land a feed, compute its signals, train the model.

Landing reads the binary files once; every later job starts from Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tickloom.operators import bars, joins, rows, signals
from tickloom.plans import features, model
from tickloom.schema import (
    DATED_BAR_SUMMARY,
    DATED_ORDER_BOOK_IMBALANCE,
    DATED_STOCK_SUMMARY,
    ENRICHED_TRADES,
    LANDED_MESSAGES,
    VWAP,
)
from tickloom.schema import MESSAGES as DECODED
from tickloom.session import children, remove, scratch_path, scratch_tables, stored_bytes
from tickloom.sources import commits, frames, messages, sinks, tables

# Names of the tables below the data folder.
MESSAGES = "full_df_parquet"
TRADES = "enriched_trades_parquet"
SIGNALS = "signals"
VWAPS = "vwap_by_stock"
BARS_CSV = "dashboard_summary.csv"
STOCKS_CSV = "stock_summary.csv"
DAYS = "days"

PARTITION_BYTES = 128 * 1024 * 1024


def days(spark: SparkSession, data_dir: str) -> dict[str, str]:
    """The landed days and the version of each that counts."""
    found = {}
    for day in sorted(children(spark, f"{data_dir}/{DAYS}")):
        versions = commits.committed(spark, f"{data_dir}/{DAYS}/{day}")
        if versions:
            found[day] = versions[-1]
    return found


def _load(spark: SparkSession, data_dir: str, table: str, schema: StructType, date: str | None) -> DataFrame:
    base = f"{data_dir}/{table}"
    landed = {d: v for d, v in days(spark, data_dir).items() if date is None or d == f"trade_date={date}"}
    return commits.read(spark, base, [f"{base}/{d}/version={v}" for d, v in landed.items()], schema, ["version"])


def load_messages(spark: SparkSession, data_dir: str, date: str | None = None) -> DataFrame:
    return _load(spark, data_dir, MESSAGES, LANDED_MESSAGES, date)


def load_enriched(spark: SparkSession, data_dir: str, date: str | None = None) -> DataFrame:
    return _load(spark, data_dir, TRADES, ENRICHED_TRADES, date)


def load_imbalance(spark: SparkSession, data_dir: str) -> DataFrame:
    return tables.scan_parquet(spark, f"{data_dir}/{SIGNALS}/obi", DATED_ORDER_BOOK_IMBALANCE)


def load_summaries(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """The bar and stock summaries; empty tables when they were not written yet."""
    return (
        tables.scan_summary_csv(spark, f"{data_dir}/{BARS_CSV}", DATED_BAR_SUMMARY),
        tables.scan_summary_csv(spark, f"{data_dir}/{STOCKS_CSV}", DATED_STOCK_SUMMARY),
    )


def land(
    spark: SparkSession,
    feed: str,
    data_dir: str,
    trade_date: str,
    partition_bytes: int = PARTITION_BYTES,
) -> None:
    """Binary files of one day to landed messages and enriched trades.

    Days are landed one by one and can be landed again. A landing writes a new
    version of the day beside the one that counts; one marker then switches
    messages and trades together. A landing that fails leaves the day as it was.
    The version before is kept for readers that have begun; older ones go. Two
    landings of one day must not overlap. Range partitions follow the bytes of
    the decoded day.
    """
    day = f"trade_date={trade_date}"
    before = commits.committed(spark, f"{data_dir}/{DAYS}/{day}")
    version = commits.next_name(before)
    place = f"{day}/version={version}"
    with scratch_tables(spark):
        # The range shuffle of the sink samples its input first. Without this table
        # every file would be read, split and decoded twice.
        path = scratch_path(spark, "messages")
        messages.decode_messages(frames.read_frames(spark, feed)).write.parquet(path)
        decoded = rows.number_files(spark.read.schema(DECODED).parquet(path))
        partitions = max(1, -(-stored_bytes(spark, path) // partition_bytes))
        tape = rows.landed(decoded, trade_date).drop("trade_date")
        sinks.write_partitioned(tape, f"{data_dir}/{MESSAGES}/{place}", partitions=partitions)
        base = f"{data_dir}/{MESSAGES}"
        landed = commits.read(spark, base, [f"{base}/{place}"], LANDED_MESSAGES, ["version"])
        enriched = joins.enrich_trades(rows.trades(landed).drop("side"), rows.directory(landed))
        sinks.write_partitioned(
            enriched.drop("trade_date"), f"{data_dir}/{TRADES}/{place}", partitions=partitions
        )
    commits.commit(spark, f"{data_dir}/{DAYS}/{day}", version)
    keep = {f"version={v}" for v in (*before[-1:], version)}
    for table in (MESSAGES, TRADES):
        for name in set(children(spark, f"{data_dir}/{table}/{day}")) - keep:
            remove(spark, f"{data_dir}/{table}/{day}/{name}")
    commits.retire(spark, f"{data_dir}/{DAYS}/{day}", before[:-1], [])


def load_vwap(spark: SparkSession, data_dir: str) -> DataFrame:
    return tables.scan_parquet(spark, f"{data_dir}/{VWAPS}", VWAP)


def compute_signals(spark: SparkSession, data_dir: str, date: str | None = None) -> None:
    """Summaries, VWAPs, imbalance, market impact and volatility of one landed day, or of each in turn.

    A day's signals are computed from that day alone and replace that day's
    folders alone, so a new day costs the same however many there are.
    """
    for day in [date] if date else [d.removeprefix("trade_date=") for d in days(spark, data_dir)]:
        _signals_of(spark, data_dir, day)


def _signals_of(spark: SparkSession, data_dir: str, date: str) -> None:
    landed = load_messages(spark, data_dir, date)
    enriched = load_enriched(spark, data_dir, date)
    place = f"trade_date={date}"

    def put(write: Callable[[DataFrame, str], None], df: DataFrame, path: str) -> None:
        write(df.drop("trade_date"), f"{data_dir}/{path}/{place}")

    with scratch_tables(spark):
        put(sinks.write_summary_csv, bars.minute_bars(enriched), BARS_CSV)
        put(sinks.write_summary_csv, bars.stock_summary(enriched), STOCKS_CSV)
        put(sinks.write_signal, bars.vwap_by_stock(enriched), VWAPS)
        put(sinks.write_signal, signals.order_book_imbalance(rows.add_orders(landed)), f"{SIGNALS}/obi")
        impact = joins.market_impact(
            landed, ("stock", "stock_locate", "ts_ns", "timestamp", "price", "msg_type", "hour")
        )
        put(sinks.write_signal, impact, f"{SIGNALS}/market_impact")
        put(sinks.write_signal, signals.rolling_volatility(rows.of_type(landed, "P")), f"{SIGNALS}/volatility")


def train(spark: SparkSession, data_dir: str, top: int = 5) -> model.Outcome:
    """Features of the most traded stocks to a trained and evaluated model."""
    return model.fit_and_evaluate(features.build_features(load_messages(spark, data_dir), top))
