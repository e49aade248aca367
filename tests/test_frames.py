import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tape import directory, frame, order
from tickloom.plans.tape_views import write_feed
from tickloom.schema import FRAMES
from tickloom.sources import frames


def _plain(data: bytes):
    """All complete frames, read from the start."""
    at, out = 0, []
    while at + 2 <= len(data):
        end = at + 2 + int.from_bytes(data[at : at + 2], "big")
        if end > len(data):
            break
        out.append((at, data[at + 2 : end]))
        at = end
    return out


def _read(spark, path, **options):
    got = {}
    for row in frames.read_frames(spark, str(path), **options).collect():
        got.setdefault(row.path.rsplit("/", 1)[1], []).append((row.seq, bytes(row.payload)))
    return {name: sorted(found) for name, found in got.items()}


def _tape(rng, size):
    kinds = [
        lambda: order("A", 1, rng.randrange(2**40), 1, "B", 100, b"AAPL", 1_000_000),
        lambda: order("P", 1, rng.randrange(2**40), 1, "B", 100, b"MSFT", 1_000_000),
        lambda: directory(1, 5, b"AAPL", b"Q"),
        lambda: b"S" + bytes(11),
        lambda: b"",
    ]
    out = bytearray()
    while len(out) < size:
        out += frame(rng.choice(kinds)())
    return bytes(out)


def _odd_lengths(rng, size):
    """Payloads of any length up to the largest, full of small numbers."""
    out = bytearray()
    while len(out) < size:
        length = rng.choice([0, 1, 2, 255, 256, 65_534, 65_535, rng.randrange(65_536)])
        out += frame(bytes(rng.choices(range(4), k=length)))
    return bytes(out)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(3)
    files = {
        "tape.bin": _tape(rng, 400_000),
        "odd.bin": _odd_lengths(rng, 900_000),
        "cut.bin": _tape(rng, 200_000)[:-5],
        "cut_prefix.bin": _tape(rng, 70_000) + b"\x01",
        "tiny.bin": frame(b"x"),
        "only_prefix.bin": b"\x00\x05ab",
        "edge.bin": frame(bytes(frames.SMALLEST_RANGE - 3)) + frame(b"next") + frame(b""),
        "zeros.bin": bytes(150_001),
        "empty.bin": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, files


def test_whole_files(spark, folder):
    path, files = folder
    wanted = {n: _plain(d) for n, d in files.items() if _plain(d)}
    assert _read(spark, path) == wanted


def test_ranges_equal_whole_files(spark, folder, monkeypatch):
    path, files = folder
    monkeypatch.setattr(frames, "FAN", 3)
    wanted = {n: _plain(d) for n, d in files.items() if _plain(d)}
    assert _read(spark, path, range_bytes=1) == wanted


def test_mixed_sizes_and_odd_range(spark, folder):
    path, files = folder
    wanted = {n: _plain(d) for n, d in files.items() if _plain(d)}
    assert _read(spark, path, range_bytes=77_777) == wanted
    assert _read(spark, path, range_bytes=100_000, most_tasks=2) == wanted


def test_names_and_folders(spark, tmp_path):
    data = _tape(random.Random(2), 200_000)
    for name in ("with space.bin", "per%20cent.bin", "plus+and&.bin", "ü.bin"):
        (tmp_path / "in" / "deep er").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "deep er" / name).write_bytes(data)
    whole = _read(spark, tmp_path)
    assert len(whole) == 4 and all(v == _plain(data) for v in whole.values())
    assert _read(spark, tmp_path, range_bytes=70_000) == whole


def test_written_feed_reads_back(spark, tmp_path):
    rng = random.Random(5)
    rows = [("f", i, bytearray(rng.randbytes(rng.randrange(60)))) for i in range(500)]
    path = str(tmp_path / "feed")
    assert write_feed(spark.createDataFrame(rows, FRAMES), path) == 500
    got = frames.read_frames(spark, path)
    assert sorted(bytes(r.payload) for r in got.collect()) == sorted(bytes(r[2]) for r in rows)


@pytest.mark.parametrize("budget", [0, 41, 42, 43, 1_000, 10**9])
def test_prefix_sample(spark, tmp_path, budget):
    data = {n: _tape(random.Random(n), 3_000) for n in range(3)}
    for n, content in data.items():
        (tmp_path / f"{n}.bin").write_bytes(content)
    table = frames.read_frames(spark, str(tmp_path))
    wanted = sorted(
        (str(n), at)
        for n, content in data.items()
        for at, payload in _plain(content)
        if at + 2 + len(payload) <= budget
    )

    def got(df):
        name = F.regexp_extract("path", r"(\d+)\.bin$", 1)
        return sorted((r[0], r[1]) for r in df.select(name, "seq").collect())

    assert got(frames.prefix_sample(table, budget, slice_width=100)) == wanted
    assert got(frames.read_frames(spark, str(tmp_path), budget=budget)) == wanted
    assert got(frames.read_frames(spark, str(tmp_path), range_bytes=70_000, budget=budget)) == wanted


def test_a_budget_bounds_the_bytes_read(monkeypatch, tmp_path):
    path = tmp_path / "long.bin"
    path.write_bytes(_tape(random.Random(1), 500_000))
    read, whole = [], frames.read_bytes

    def counted(name, start, end):
        read.append((start, end))
        return whole(name, start, end)

    monkeypatch.setattr(frames, "read_bytes", counted)
    batch = pa.RecordBatch.from_pydict({"path": [str(path)], "length": [10_000]})
    found = list(frames.split_files(iter([batch])))
    assert read == [(0, 10_000)] and found[-1].column(1).to_pylist()[-1] < 10_000


def test_ranges_behind_the_budget_are_not_planned(spark, tmp_path):
    (tmp_path / "long.bin").write_bytes(_tape(random.Random(1), 900_000))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    listed = frames.cut_ranges(frames.within(files, 100_000), frames.SMALLEST_RANGE)
    assert [(r.start, r.end) for r in listed.orderBy("no").collect()] == [(0, 65_537), (65_537, 100_000)]
