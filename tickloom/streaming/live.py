"""The tape as a stream: land what arrives, and keep the bars up to date.

A stream only appends rows; nothing waits for a watermark, so no row is late.
For binary files Spark's stream keeps account of which files have arrived; their
bytes are read by the batch reader in ranges, so one long file is many tasks.
Each run of a landing is a folder that counts once it is complete, and runs
follow one another: two landings of one path must not overlap.

Bars, imbalance and candles are kept as sums that can be added up
(`partial.py`). A run adds the sums of its own rows, so its cost follows what is
new; a file that arrives late, of an earlier hour or day, changes the bars it
belongs to. Readers add the runs up, and `compact` folds them into one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tickloom.functions.times import MINUTE_NS
from tickloom.schema import LISTED
from tickloom.sources import commits
from tickloom.sources.frames import MOST_TASKS, RANGE_BYTES, read_listed
from tickloom.streaming.partial import Kind

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Name and length of the binary files that arrive below `path`, as a stream."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True)
    return files.load(path).select("path", "length")


def land_feed(
    spark: SparkSession,
    feed: str,
    path: str,
    checkpoint: str,
    decode: Callable[[DataFrame], DataFrame],
    range_bytes: int = RANGE_BYTES,
    most_tasks: int = MOST_TASKS,
) -> str | None:
    """Land the files that have arrived since the last run; the run's name, or None.

    `decode` turns frames into the rows to land. The list of a run's files and
    its rows become visible together; a run that failed is made up for by the
    next, as its files were never listed as landed.
    """
    names = f"{checkpoint}/names"
    land(arrivals(spark, feed), names, f"{checkpoint}/stream").awaitTermination()
    runs = commits.committed(spark, path)
    taken = commits.read(spark, f"{path}/files", [f"{path}/files/run={r}" for r in runs], LISTED, ["run"])
    seen = spark.read.schema(LISTED).parquet(names).dropDuplicates(["path"])
    new = seen.join(taken.select("path"), "path", "left_anti")
    if new.isEmpty():
        return None
    run = commits.next_name(runs)
    listed = f"{path}/files/run={run}"
    new.write.parquet(listed)
    frames = read_listed(spark.read.schema(LISTED).parquet(listed), range_bytes, most_tasks)
    decode(frames).write.parquet(f"{path}/rows/run={run}")
    commits.commit(spark, path, run)
    return run


def landed(spark: SparkSession, path: str, schema: StructType, after: int = -1) -> DataFrame:
    """The rows of all runs of a landing, or of those behind number `after`."""
    runs = [r for r in commits.committed(spark, path) if commits.number(r) > after]
    return commits.read(spark, f"{path}/rows", [f"{path}/rows/run={r}" for r in runs], schema, ["run"])


def _parts(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The parts that cover every run once, and the last run covered.

    A part is named by its last and its first run; a folded one covers several.
    """
    covered, chosen = -1, []
    spans = [(int(n.split("-")[1]), -commits.number(n), n) for n in commits.committed(spark, path)]
    for first, last, name in sorted(spans):
        if first > covered:
            chosen.append(name)
            covered = -last
    return chosen, covered


def _part(spark: SparkSession, path: str, sums: DataFrame, first: int, last: int) -> None:
    unique = commits.next_name([]).split("-")[1]
    name = f"{last:0{commits.DIGITS}d}-{first:0{commits.DIGITS}d}-{unique}"
    sums.write.parquet(f"{path}/part={name}")
    commits.commit(spark, path, name)


def update_sums(
    spark: SparkSession,
    kind: Kind,
    source: str,
    schema: StructType,
    path: str,
    bar_ns: int = MINUTE_NS,
    mode: str = "floor",
) -> None:
    """Add the sums of the runs of the landing `source` that `path` does not have yet."""
    _, covered = _parts(spark, path)
    last = max(map(commits.number, commits.committed(spark, source)), default=-1)
    if last > covered:
        _part(spark, path, kind.sums(landed(spark, source, schema, covered), bar_ns, mode), covered + 1, last)


def summed(spark: SparkSession, kind: Kind, path: str, dated: bool = False) -> DataFrame:
    """The sums of all runs, added up."""
    parts, _ = _parts(spark, path)
    schema = StructType.fromDDL(kind.schema(dated))
    return kind.added(commits.read(spark, path, [f"{path}/part={n}" for n in parts], schema, ["part"]))


def compact(spark: SparkSession, kind: Kind, path: str, dated: bool = False) -> None:
    """Fold all parts into one. Readers see the old parts or the new one, never both."""
    parts, last = _parts(spark, path)
    if len(parts) > 1:
        old = commits.committed(spark, path)
        _part(spark, path, summed(spark, kind, path, dated), 0, last)
        commits.retire(spark, path, old, [f"{path}/part={n}" for n in old])


def land(
    rows: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Append rows to a Parquet table, each once; takes what has arrived, then stops."""
    return (
        rows.writeStream.format("parquet")
        .partitionBy(*partition_by)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def refresh(
    landed: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    path: str,
    dates: Sequence[str],
) -> None:
    """Sum the bars of the given days again and replace their folders."""
    days = landed.where(F.col("trade_date").isin([F.lit(d).cast("date") for d in dates]))
    (
        operator(days)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("trade_date")
        .parquet(path)
    )
