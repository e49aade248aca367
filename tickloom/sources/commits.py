"""Folders that count only once they are complete.

A writer fills a folder of its own, then adds one empty marker file below
`<root>/_committed`. Readers list the markers and read the folders they name, so
a writer that fails leaves nothing behind that anyone sees, and what was there
before stays until the marker of the new folder exists. Markers begin with a
growing number; creating one is a single step on every file system.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tickloom.session import children, remove, touch

_MARKERS = "_committed"
DIGITS = 10


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names of the complete folders of `root`, oldest first."""
    return sorted(children(spark, f"{root}/{_MARKERS}"))


def commit(spark: SparkSession, root: str, name: str) -> None:
    touch(spark, f"{root}/{_MARKERS}/{name}")


def retire(spark: SparkSession, root: str, names: Sequence[str], folders: Sequence[str]) -> None:
    """Remove markers, then the folders behind them."""
    for name in names:
        remove(spark, f"{root}/{_MARKERS}/{name}")
    for folder in folders:
        remove(spark, folder)


def number(name: str) -> int:
    return int(name.split("-")[0])


def next_name(names: Sequence[str]) -> str:
    """A name behind all of `names` that no other writer has."""
    last = max(map(number, names), default=-1)
    return f"{last + 1:0{DIGITS}d}-{uuid.uuid4().hex[:12]}"


def read(
    spark: SparkSession, base: str, folders: Sequence[str], schema: StructType, hidden: Sequence[str] = ()
) -> DataFrame:
    """The Parquet `folders` below `base` as one table with the columns of `schema`.

    `key=value` steps of a path are columns, and those in `hidden` are left out.
    """
    if not folders:
        return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).option("basePath", base).parquet(*folders)
    return table.drop(*hidden).select(*schema.names)
