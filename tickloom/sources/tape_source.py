"""Binary tape files as a Spark data source: `spark.read.format("tape")`.

The reader knows where the kind and the stock of a frame lie. It tests both on
the raw bytes, so frames that a query does not want are never cut out or sent to
the JVM. What is left is decoded by the built-in expressions of `messages.py`.

Which kinds and stocks a load reads is set by its options, and filters that say
the same are taken over from Spark (`PushedFilters` of the plan). Other filters
stay with Spark. Spark 4.1 hands what a reader has accepted to all scans of one
load: a union of two filtered scans of it then gave the second one's rows twice.
A reader that accepted filters of each scan would so lose rows; the options are
the same for all scans.

`read` plans the byte ranges of long files as a Spark job first (`frames.py`) and
gives the plan to the source. A plain `load(path)` takes each file as one part.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
)

from tickloom.session import scratch_path, ship_package
from tickloom.sources import frames
from tickloom.sources.messages import (
    DIRECTORY_LENGTH,
    DIRECTORY_STOCK,
    ORDER_LENGTH,
    STOCK,
    decode_tagged,
)

FORMAT = "tape"
SCHEMA = "path string, seq bigint, msg_type string, stock string, payload binary"
WINDOW = 64 * 1024 * 1024
ROWS = 50_000

# By kind: least length of a payload, and where its stock lies.
_KINDS = {"R": (DIRECTORY_LENGTH, *DIRECTORY_STOCK), "A": (ORDER_LENGTH, *STOCK), "P": (ORDER_LENGTH, *STOCK)}
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("seq", pa.int64()),
        ("msg_type", pa.string()),
        ("stock", pa.string()),
        ("payload", pa.binary()),
    ]
)


class TapePart(InputPartition):
    """Byte ranges (path, start, end, length) that one task reads in turn."""

    def __init__(self, number: int, ranges: list[tuple[str, int, int, int]]):
        super().__init__(number)
        self.ranges = ranges


def _name(raw: bytes) -> str | None:
    try:
        return raw.decode().strip()
    except UnicodeDecodeError:
        return None


class TapeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path")
        self.plan = options.get("plan")
        self.kinds = set(json.loads(options.get("msg_type", json.dumps([*_KINDS]))))
        self.stocks = set(json.loads(options["stock"])) if "stock" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (Spark's name)
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            known = {("msg_type",): self.kinds, ("stock",): self.stocks}
            column = getattr(f, "attribute", None)
            implied = column in known and (
                isinstance(f, IsNotNull)  # neither is ever null
                or (wanted is not None and known[column] is not None and known[column] <= wanted)
            )
            if not implied:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        tasks: dict[int, list] = defaultdict(list)
        if self.plan:
            system, name = frames.locate(self.plan)
            table = ds.dataset(name, filesystem=system, format="parquet").to_table()
            rows = zip(*[table.column(c).to_pylist() for c in ("task", "path", "start", "end", "length")])
            for task, *span in rows:
                tasks[task].append(tuple(span))
        else:
            system, name = frames.locate(self.path)
            found = system.get_file_info(fs.FileSelector(name, recursive=True))
            for number, info in enumerate(f for f in found if f.is_file and f.size):
                tasks[number].append((f"file:{info.path}" if info.path.startswith("/") else info.path, 0, info.size, info.size))
        # Without any part Spark would read one that is None.
        return [TapePart(n, sorted(ranges)) for n, ranges in sorted(tasks.items())] or [TapePart(0, [])]

    def read(self, partition: TapePart) -> Iterator[pa.RecordBatch]:
        for path, start, end, length in partition.ranges:
            at = start
            while at < end:
                stop = min(at + WINDOW, end)
                data = frames.read_bytes(path, at, min(stop + frames.ENTRIES, length))
                borders = np.frombuffer(frames.frame_starts(data, stop - at), dtype=np.int64)
                yield from self._wanted(path, data, at, borders)
                if borders[-1] < stop - at:  # an incomplete frame ends the file
                    break
                at += int(borders[-1])

    def _wanted(self, path: str, data: bytes, base: int, borders: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The frames that pass, tested on their bytes before any is cut out."""
        content = np.frombuffer(data, dtype=np.uint8)
        starts, sizes = borders[:-1] + frames.PREFIX, np.diff(borders) - frames.PREFIX
        filled = sizes > 0
        kind_of = np.where(filled, content[np.minimum(starts, max(len(content) - 1, 0))], 0) if len(starts) else sizes
        known: dict[bytes, str | None] = {}
        parts = []
        for kind in sorted(self.kinds & set(_KINDS)):
            least, offset, width = _KINDS[kind]
            at = np.flatnonzero((kind_of == ord(kind)) & (sizes >= least))
            raw = content[(starts[at] + offset)[:, None] + np.arange(width)]
            codes, of = np.unique(np.ascontiguousarray(raw).view(f"V{width}").ravel(), return_inverse=True)
            names = [known.setdefault(c.tobytes(), _name(c.tobytes())) for c in codes]
            keep = np.array([n is not None and (self.stocks is None or n in self.stocks) for n in names], bool)
            kept = keep[of] if len(at) else np.zeros(0, bool)
            parts += [(i, kind, names[code]) for i, code in zip(at[kept].tolist(), of[kept].tolist())]
        parts.sort()
        for first in range(0, len(parts), ROWS):
            some = parts[first : first + ROWS]
            chosen = np.array([i for i, _, _ in some], dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes[chosen])))
            # Only the bytes of the chosen frames are gathered.
            place = np.repeat(starts[chosen] - ends[:-1], sizes[chosen]) + np.arange(ends[-1])
            payloads = pa.BinaryArray.from_buffers(
                pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(content[place])]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(path, len(some)).cast(pa.string()),
                    pa.array(borders[:-1][chosen] + base),
                    pa.array([k for _, k, _ in some], pa.string()),
                    pa.array([n for _, _, n in some], pa.string()),
                    payloads,
                ],
                schema=_ARROW,
            )


class TapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TapeReader:
        return TapeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TapeSource)


def read(
    spark: SparkSession,
    path: str,
    range_bytes: int = frames.RANGE_BYTES,
    most_tasks: int = frames.MOST_TASKS,
    budget: int | None = None,
    kinds: Sequence[str] | None = None,
    stocks: Sequence[str] | None = None,
) -> DataFrame:
    """Frames of known kind below `path` as (path, seq, msg_type, stock, payload), files of any length in ranges.

    With `kinds` or `stocks` only those; the filter is the source's.
    """
    register(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    planned = scratch_path(spark, "tape-plan")
    ranges = frames.planned_ranges(files, range_bytes, most_tasks, budget)
    ranges.select("task", "path", F.col("at").alias("start"), "end", "length").write.parquet(planned)
    source, chosen = spark.read.format(FORMAT).option("plan", planned), F.lit(True)
    for column, values in (("msg_type", kinds), ("stock", stocks)):
        if values is not None:
            source = source.option(column, json.dumps([*values]))
            chosen &= F.col(column).isin([*values])
    return source.load().where(chosen)


def messages(spark: SparkSession, path: str, **options) -> DataFrame:
    """The messages of `decode_messages`, or those of some kinds or stocks."""
    return decode_tagged(read(spark, path, **options))
