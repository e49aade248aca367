"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# What the jobs need from a session. Cluster sizing (executors, memory, shuffle
# partitions) is left to the submitter and to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_KEPT: list[tempfile.TemporaryDirectory] = []
_LOCAL: dict[str, str] = {}
_MADE: list[str] = []
_SHIPPED: set[str] = set()


def build_session(app: str = "tickloom", **conf: str) -> SparkSession:
    """A session with `SETTINGS`; `conf` adds to them."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Needed before a Python stage when the package is neither installed on the
    executors nor submitted with `--py-files`.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _SHIPPED or not os.path.isdir(package):
        return
    folder = tempfile.TemporaryDirectory(prefix="tickloom-", ignore_cleanup_errors=True)
    _KEPT.append(folder)
    parent, name = os.path.split(package)
    archive = shutil.make_archive(os.path.join(folder.name, name), "zip", parent, name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    A local session without the setting gets a temporary folder that goes away
    with the process. On a cluster a missing setting is an error, as a
    machine-local folder would be lost with its machine.
    """
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
    )
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        folder = tempfile.TemporaryDirectory(prefix="tickloom-", ignore_cleanup_errors=True)
        _KEPT.append(folder)
        _LOCAL[application] = folder.name
    return _LOCAL[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; `scratch_tables` removes it."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    """The path's Hadoop file system, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _hadoop(spark, path)
    system.mkdirs(place)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file within one file system."""
    system, place = _hadoop(spark, source)
    if not system.rename(place, _hadoop(spark, target)[1]):
        raise OSError(f"cannot move {source} to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    system, place = _hadoop(spark, path)
    if not system.exists(place):
        return []
    return [status.getPath().getName() for status in system.listStatus(place)]


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file; an error if it is there."""
    system, place = _hadoop(spark, path)
    system.create(place, False).close()


def remove(spark: SparkSession, path: str) -> None:
    system, place = _hadoop(spark, path)
    system.delete(place, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files below `path`."""
    system, place = _hadoop(spark, path)
    return system.getContentSummary(place).getLength()


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made inside the block when it ends.

    For jobs whose results are written; a DataFrame that still reads a scratch
    table must be used up before.
    """
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            remove(spark, path)
        del _MADE[before:]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Used where several actions follow one expensive plan. The written table
    outlives lost executors and keeps column pruning for its readers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
