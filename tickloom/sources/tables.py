"""Parquet and CSV tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.slices import numbered


def scan_parquet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet folder, with or without `key=value` folders inside.

    The schema is given, not inferred: an all-digit ticker stays text and no file
    is opened before the query runs.
    """
    return spark.read.schema(schema).parquet(path)


def scan_summary_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A summary written as CSV with a header, as a whole or in folders by day; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def normalise_legacy(legacy: DataFrame, order: tuple[str, ...] = ("time",)) -> DataFrame:
    """Give a legacy table the columns of the bar summary where they are missing.

    `volume` is taken from `shares`, `minute_bucket` is the row number in `order`
    (only for tables with a `time`), `market_cat` is 'Unknown'. Rows equal in
    `order` are numbered by their other columns, so the numbers are determined.
    """
    columns = set(legacy.columns)
    out = legacy
    if "volume" not in columns and "shares" in columns:
        out = out.withColumn("volume", F.col("shares"))
    if "minute_bucket" not in columns and "time" in columns:
        rest = [c for c in legacy.columns if c not in order]
        out = numbered(out, [*order, *rest], "minute_bucket")
    if "market_cat" not in columns:
        out = out.withColumn("market_cat", F.lit("Unknown"))
    return out
