"""Length-prefixed binary files to a table of frames.

A file is a sequence of `uint16 big-endian length || payload`. Where a frame
starts is known only from the frame before it, so a file cannot simply be cut.

Files are read in byte ranges by one reader, whatever their size. A file of one
range is split at once. In longer files a frame may reach at most 65,536 bytes
into the next range, so for every possible entry point of a range the matching
exit point is worked out on its own, all ranges in parallel; chains that start
at different points soon run into each other, so this costs about one pass. The
exits are then chained range by range, in a tree, to find the true entry of
each range, and the ranges are split in parallel from there. The result is the
same as reading from the start.

Splitting bytes is the one place where Python touches the data path; fields are
decoded by built-in expressions (`messages.py`).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.slices import running_total
from tickloom.schema import FRAMES
from tickloom.session import materialise, ship_package

PREFIX = 2
ENTRIES = PREFIX + 65_535  # possible entry points of a range: 0 .. 65,536
SMALLEST_RANGE = ENTRIES
RANGE_BYTES = 64 * 1024 * 1024
RANGES_PER_TASK = 4
MOST_TASKS = 50_000
FAN = 64  # tables chained in one group: 64 x 256 KiB
BATCH = 30_000  # frames of at most 65,535 bytes: below 2 GiB, the limit of a batch

_ARROW_FRAMES = pa.schema(
    [("path", pa.string()), ("seq", pa.int64()), ("payload", pa.binary())]
)


def read_frames(
    spark: SparkSession,
    path: str,
    range_bytes: int = RANGE_BYTES,
    most_tasks: int = MOST_TASKS,
    budget: int | None = None,
) -> DataFrame:
    """All complete frames below `path` as (path, seq, payload).

    `seq` is the byte offset of the frame in its file. An incomplete frame at
    the end of a file is left out. Spark lists the files; their bytes are read
    with Arrow's file systems (local, HDFS, S3, GCS; tried: local). Beyond
    `most_tasks` tasks a task takes more ranges, one after the other. With a
    `budget` only the first so many bytes of each file are planned and read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return read_listed(files.select("path", "length"), range_bytes, most_tasks, budget)


def read_listed(
    files: DataFrame,
    range_bytes: int = RANGE_BYTES,
    most_tasks: int = MOST_TASKS,
    budget: int | None = None,
) -> DataFrame:
    """`read_frames` for a table of (path, length)."""
    width = max(range_bytes, SMALLEST_RANGE)
    files = within(files, budget).filter("length > 0").select("path", "length")
    ship_package(files.sparkSession)
    short = files.filter(F.col("length") <= width).mapInArrow(split_files, FRAMES)
    long = files.filter(F.col("length") > width)
    return short if long.isEmpty() else short.unionByName(_read_ranges(long, width, most_tasks))


def within(files: DataFrame, budget: int | None) -> DataFrame:
    """Files as if they ended at `budget`: the frames that end before it are those of a shorter file."""
    if budget is None:
        return files
    return files.withColumn("length", F.least("length", F.lit(budget).cast("bigint")))


def split_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of short files (path, length), each read at once."""
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield from _frame_batches(path, read_bytes(path, 0, length), 0, length)


def prefix_sample(frames: DataFrame, budget: int, slice_width: int = RANGE_BYTES) -> DataFrame:
    """Frames of each file whose bytes, prefixes included, end within `budget`.

    For frames that are a table already; `read_frames(budget=...)` does not read
    the rest of a file at all.
    """
    size = F.octet_length("payload").cast("bigint") + F.lit(PREFIX)
    summed = running_total(frames, ["path"], "seq", size, slice_width, "__bytes")
    return summed.filter(F.col("__bytes") <= budget).drop("__bytes")


def frame_starts(data: bytes, stop: int) -> array:
    """Starts of the complete frames that begin before `stop`, then where the last ends."""
    at, size, starts = 0, len(data), array("q")
    while at < stop and at + PREFIX <= size:
        end = at + PREFIX + (data[at] << 8 | data[at + 1])
        if end > size:
            break
        starts.append(at)
        at = end
    starts.append(at)
    return starts


def _frame_batches(
    path: str, data: bytes, base: int, stop: int
) -> Iterator[pa.RecordBatch]:
    """Only the walk over the prefixes is a loop; payloads are cut out all at once."""
    borders = np.frombuffer(frame_starts(data, stop), dtype=np.int64)
    content = np.frombuffer(data, dtype=np.uint8)
    for first in range(0, len(borders) - 1, BATCH):
        part = borders[first : first + BATCH + 1]
        starts = part[:-1]
        piece, inside = content[part[0] : part[-1]], starts - part[0]
        keep = np.ones(len(piece), dtype=bool)
        keep[inside] = keep[inside + 1] = False
        ends = np.concatenate(([0], np.cumsum(np.diff(part) - PREFIX))).astype(np.int32)
        payloads = pa.BinaryArray.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(piece[keep])]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(path, len(starts)), pa.array(starts + base), payloads],
            schema=_ARROW_FRAMES,
        )


# --- byte ranges of large files ----------------------------------------------


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path as Spark shows it, and the name in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem(), "/" + (rest or scheme).lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def open_file(path: str, mode: str = "r"):
    """A file of any file system Arrow knows, by the path Spark shows."""
    filesystem, name = locate(path)
    if mode == "w":
        filesystem.create_dir(name.rpartition("/")[0])
        return filesystem.open_output_stream(name)
    return filesystem.open_input_file(name)


def read_bytes(path: str, start: int, end: int) -> bytes:
    with open_file(path) as source:
        return source.read_at(end - start, start)


def _exits(data: bytes, end: int) -> array:
    """For each entry point, how far its chain of frames reaches past `end`.

    `data` has one byte more than the range, for a prefix across the border.
    """
    chain_at = array("i", bytes(4 * end))  # number of the chain through a byte
    reach = [0]  # by number of the chain
    exits = array("i", bytes(4 * ENTRIES))
    for entry in range(min(ENTRIES, end)):
        if not chain_at[entry]:
            number, at = len(reach), entry
            while at < end and not chain_at[at]:
                chain_at[at] = number
                at += PREFIX + (data[at] << 8 | data[at + 1])
            reach.append(at - end if at >= end else reach[chain_at[at]])
        exits[entry] = reach[chain_at[entry]]
    return exits


def _range_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data = read_bytes(row["path"], row["start"], min(row["end"] + 1, row["length"]))
            table = _exits(data + b"\0", row["end"] - row["start"])
            yield pa.RecordBatch.from_pydict(
                {"path": [row["path"]], "no": [row["no"]], "exits": [table.tobytes()]},
                schema=pa.schema(
                    [("path", pa.string()), ("no", pa.int64()), ("exits", pa.binary())]
                ),
            )


def _chained(group):
    """One table for a run of consecutive ranges."""
    group = group.sort_values("no")
    through = np.arange(ENTRIES, dtype=np.int32)
    for table in group["exits"]:
        through = np.frombuffer(table, dtype=np.int32)[through]
    return group.head(1).assign(no=group["up"].iloc[0], exits=through.tobytes())[
        ["path", "no", "exits"]
    ]


def _entered(group):
    """Entry points of a run of ranges from the entry point of the run."""
    group = group.sort_values("no")
    at, entries = int(group["entry"].iloc[0]), []
    for table in group["exits"]:
        entries.append(at)
        at = int(np.frombuffer(table, dtype=np.int32)[at])
    return group.assign(entry=entries)[["path", "no", "entry"]]


def _split_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            # The last frame of the range may end in the next one.
            data = read_bytes(row["path"], row["at"], min(row["end"] + ENTRIES, row["length"]))
            yield from _frame_batches(row["path"], data, row["at"], row["end"] - row["at"])


def cut_ranges(files: DataFrame, width: int) -> DataFrame:
    """(path, length, no, start, end) of the byte ranges of files."""
    return files.select(
        "path",
        "length",
        F.explode(F.expr(f"sequence(0L, (length - 1) div {width})")).alias("no"),
    ).withColumns(
        {
            "start": F.col("no") * width,
            "end": F.least((F.col("no") + 1) * width, F.col("length")),
        }
    )


def planned_ranges(
    files: DataFrame,
    range_bytes: int = RANGE_BYTES,
    most_tasks: int = MOST_TASKS,
    budget: int | None = None,
) -> DataFrame:
    """(path, at, end, length, task) of all ranges of files; the first frame of a range starts `at`.

    Short files are one range. Tasks are numbered so that each has a few ranges.
    """
    width = max(range_bytes, SMALLEST_RANGE)
    files = within(files, budget).filter("length > 0").select("path", "length")
    whole = files.filter(F.col("length") <= width)
    long = files.filter(F.col("length") > width)
    planned = whole.select("path", F.lit(0).cast("bigint").alias("at"), F.col("length").alias("end"), "length")
    if not long.isEmpty():
        planned = planned.unionByName(_entered_ranges(long, width, most_tasks).select("path", "at", "end", "length"))
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = min(max(1, total // (width * RANGES_PER_TASK)), most_tasks)
    return planned.withColumn("task", F.pmod(F.xxhash64("path", "at"), F.lit(tasks)).cast("bigint"))


def _read_ranges(files: DataFrame, width: int, most_tasks: int) -> DataFrame:
    tasks = _tasks(files, width, most_tasks)
    entered = _entered_ranges(files, width, most_tasks)
    return entered.repartition(tasks, "path", "at").mapInArrow(_split_ranges, FRAMES)


def _tasks(files: DataFrame, width: int, most_tasks: int) -> int:
    total = files.agg(F.sum("length")).first()[0]
    return min(max(1, total // (width * RANGES_PER_TASK)), most_tasks)


def _entered_ranges(files: DataFrame, width: int, most_tasks: int) -> DataFrame:
    """The ranges of long files with the place of their first frame, for those that have one."""
    ship_package(files.sparkSession)
    longest = files.agg(F.max("length")).first()[0]
    tasks = _tasks(files, width, most_tasks)
    ranges = cut_ranges(files, width).repartition(tasks, "path", "no")

    table_schema = "path string, no bigint, exits binary"
    levels = [materialise(ranges.mapInArrow(_range_tables, table_schema), "exits")]
    count = (longest - 1) // width + 1
    while count > 1:
        up = levels[-1].withColumn("up", F.expr(f"no div {FAN}"))
        chained = up.groupBy("path", "up").applyInPandas(_chained, table_schema)
        levels.append(materialise(chained, "exits"))
        count = (count - 1) // FAN + 1

    entries = levels.pop().select("path", "no", F.lit(0).cast("bigint").alias("entry"))
    while levels:
        parents = entries.withColumnRenamed("no", "up")
        children = levels.pop().withColumn("up", F.expr(f"no div {FAN}"))
        entries = (
            children.join(parents, ["path", "up"])
            .groupBy("path", "up")
            .applyInPandas(_entered, "path string, no bigint, entry bigint")
        )
    placed = ranges.join(entries, ["path", "no"]).withColumn("at", F.col("start") + F.col("entry"))
    # An incomplete frame may reach past a range, and past the end.
    return placed.where(F.col("at") < F.least("end", "length"))
