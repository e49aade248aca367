"""Parquet and CSV sinks. All write from the executors; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("msg_type", "hour"),
    cluster_by: Sequence[str] = ("stock", "ts_ns"),
    rows_per_file: int = 20_000_000,
    partitions: int | None = None,
) -> None:
    """Overwrite `path` with Parquet folders, range-clustered inside each folder.

    Rows are range-shuffled on (folders, stock, time) first. A folder then gets
    few files, a stock lies in few row groups, and a hot stock is still spread
    over many tasks because time is part of the range key. Folders per stock
    (`partition_by=("stock", "msg_type", "hour")`) are possible but make a folder
    per ticker, type and hour. `partitions` is the number of range partitions:
    give it for large tables, as adaptive execution merges small partitions of a
    range shuffle but never splits large ones.
    """
    folders = list(partition_by)
    order = [*folders, *[c for c in cluster_by if c not in folders]]
    (
        df.repartitionByRange(*([partitions] if partitions else []), *order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy(*folders)
        .option("compression", "snappy")
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )


def write_signal(df: DataFrame, path: str) -> None:
    """Overwrite `path` with plain Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_summary_csv(df: DataFrame, path: str) -> None:
    """Overwrite `path` with CSV files, each with a header, in the order of `df`."""
    df.write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, n: int = 5) -> None:
    """Print the first `n` rows."""
    df.show(n, truncate=False)
