"""The data source gives what the frame reader and the decoder give, and takes filters to the bytes."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tape import directory, frame, header, order
from tickloom.sources import frames, tape_source
from tickloom.sources.messages import decode_messages


def _feed(folder, sizes=(400, 3_000)):
    rng = random.Random(6)
    names = [b"AAPL", b" MSFT\t", "Ü".encode(), b"\xff\xfe", b"7", b""]
    for number, count in enumerate(sizes):
        data = frame(directory(1, 1, b"AAPL", b"Q")) + frame(b"") + frame(header("R", 1, 1)) + frame(b"P")
        for i in range(count):
            kind = rng.choice("APPRXA")
            if kind == "R":
                data += frame(directory(i, i, rng.choice(names), b"Q"))
            else:
                data += frame(order(kind, i % 99, i, i, "B", 1 + i, rng.choice(names), 10_000 + i))
            if rng.random() < 0.02:
                data += frame(rng.randbytes(rng.randrange(60_000)) if rng.random() < 0.1 else b"Xother")
        (folder / f"{number}.bin").write_bytes(data + b"\0\x09cut")
    return str(folder)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("range_bytes", [frames.RANGE_BYTES, frames.SMALLEST_RANGE])
def test_equal_to_the_decoder(spark, tmp_path, range_bytes):
    feed = _feed(tmp_path)
    wanted = decode_messages(frames.read_frames(spark, feed))
    found = tape_source.messages(spark, feed, range_bytes=range_bytes)
    assert found.columns == wanted.columns
    assert _rows(found) == _rows(wanted)
    for condition in (
        "msg_type = 'P'",
        "msg_type in ('R', 'P') and stock = 'AAPL'",
        "stock in ('MSFT', '7') and shares > 100",
        "msg_type = 'X'",
        "stock = '' or ts_ns < 5",
        "msg_type <> 'A' and stock is not null",
    ):
        assert _rows(found.where(condition)) == _rows(wanted.where(condition)), condition


@pytest.mark.parametrize(
    ("kinds", "stocks"), [(["P"], None), (["A", "P"], ["7", "MSFT"]), (None, ["AAPL"]), (["X"], None), ([], []), (None, ["it's"])]
)
def test_chosen_kinds_and_stocks(spark, tmp_path, kinds, stocks):
    feed = _feed(tmp_path, (300,))
    wanted = decode_messages(frames.read_frames(spark, feed))
    wanted = wanted.where(F.col("msg_type").isin(kinds)) if kinds is not None else wanted
    wanted = wanted.where(F.col("stock").isin(stocks)) if stocks is not None else wanted
    assert _rows(tape_source.messages(spark, feed, kinds=kinds, stocks=stocks)) == _rows(wanted)


def test_filters_are_shown_as_pushed(spark, tmp_path):
    found = tape_source.messages(spark, _feed(tmp_path, (50,)), kinds=["P"], stocks=["AAPL"])

    def formatted(df):
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return df._jdf.queryExecution().explainString(mode)

    plan = formatted(found)
    pushed = "PushedFilters: [IsNotNull(msg_type), IsNotNull(stock), EqualTo(msg_type,P), EqualTo(stock,AAPL)]"
    assert pushed in plan and "Condition" not in plan
    narrower = formatted(found.where("seq > 5 and msg_type = 'P'"))
    (condition,) = [line for line in narrower.splitlines() if line.startswith("Condition")]
    assert "seq" in condition and "msg_type" not in condition and pushed.split(",")[0] in narrower


def test_scans_of_one_load_do_not_share_filters(spark, tmp_path):
    """What one scan filters does not reach another scan of the same load."""
    found = tape_source.read(spark, _feed(tmp_path, (300,)))
    counts = {r.msg_type: r["count"] for r in found.groupBy("msg_type").count().collect()}
    both = found.where("msg_type = 'P'").union(found.where("msg_type = 'A'"))
    assert {r.msg_type: r["count"] for r in both.groupBy("msg_type").count().collect()} == {k: counts[k] for k in "PA"}
    assert found.count() == sum(counts.values())


def test_only_chosen_frames_are_cut(tmp_path):
    feed = _feed(tmp_path, (500,))
    reader = tape_source.TapeReader({"path": feed, "msg_type": '["P"]', "stock": '["7"]'})
    same = [tape_source.EqualTo(("msg_type",), "P"), tape_source.In(("stock",), ("7", "no"))]
    other = tape_source.EqualTo(("stock",), "AAPL")
    assert list(reader.pushFilters([*same, other])) == [other]
    (part,) = reader.partitions()
    table = pa.Table.from_batches(list(reader.read(part)))
    assert set(table["msg_type"].to_pylist()) == {"P"} and set(table["stock"].to_pylist()) == {"7"}
    assert {len(p) for p in table["payload"].to_pylist()} == {36}


def test_plain_load(spark, tmp_path):
    feed = _feed(tmp_path)
    tape_source.register(spark)
    loaded = spark.read.format("tape").load(feed)
    assert loaded.count() == decode_messages(frames.read_frames(spark, feed)).count()
    assert loaded.rdd.getNumPartitions() == 2


def test_windows_join_up(spark, tmp_path, monkeypatch):
    feed = _feed(tmp_path, (2_000,))
    reader = tape_source.TapeReader({"path": feed})
    (part,) = reader.partitions()
    whole = pa.Table.from_batches(list(reader.read(part)))
    monkeypatch.setattr(tape_source, "WINDOW", 5_000)
    assert pa.Table.from_batches(list(reader.read(part))).equals(whole)


def test_a_budget_and_no_files(spark, tmp_path):
    feed = _feed(tmp_path, (300,))
    wanted = decode_messages(frames.read_frames(spark, feed, budget=5_000))
    assert _rows(tape_source.messages(spark, feed, budget=5_000)) == _rows(wanted)
    (tmp_path / "0.bin").write_bytes(b"")
    assert tape_source.messages(spark, feed).count() == 0
