from pyspark.sql import functions as F

from tape import directory, order
from tickloom.operators import rows
from tickloom.schema import FRAMES, MESSAGES
from tickloom.sources.messages import decode_messages, rejected_frames


def _decoded(spark, *payloads):
    frames = spark.createDataFrame(
        [("f", i, bytearray(p)) for i, p in enumerate(payloads)], FRAMES
    )
    return frames, {r.seq: r for r in decode_messages(frames).collect()}


def test_fields_of_each_kind(spark):
    _, got = _decoded(
        spark,
        directory(7, 123, b"AAPL", b"Q"),
        order("A", 65535, 2**48 - 1, 42, "S", 2**32 - 1, b"MSFT", 2**32 - 1),
        order("P", 1, 5, 99, "B", 100, b"MSFT", 1234567),
    )
    r, a, p = got[0], got[1], got[2]
    assert (r.msg_type, r.stock_locate, r.ts_ns, r.stock, r.market_cat) == (
        "R", 7, 123, "AAPL", "Q",
    )
    assert (r.shares, r.price_ticks, r.price, r.order_ref, r.side) == (None,) * 5
    assert (a.stock_locate, a.ts_ns, a.order_ref, a.side) == (65535, 2**48 - 1, 42, "S")
    assert (a.shares, a.price_ticks, a.price) == (2**32 - 1, 2**32 - 1, (2**32 - 1) / 10000.0)
    assert a.market_cat is None
    assert (p.order_ref, p.side, p.price) == (None, "B", 123.4567)


def test_schema_is_fixed(spark):
    frames, _ = _decoded(spark, directory(7, 123, b"AAPL", b"Q"))
    got = decode_messages(frames).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in MESSAGES]


def test_rejected(spark):
    good = order("A", 1, 1, 1, "B", 1, b"X", 1)
    frames, got = _decoded(
        spark,
        b"",
        b"E" + good[1:],
        directory(1, 1, b"X", b"")[:19],
        good[:35],
        order("P", 1, 1, 1, "B", 1, b"\xff\xfe", 1),
        directory(1, 1, b"\xc3\x28", b"Q"),
        good,
        b"P",
    )
    assert set(got) == {6}
    reasons = {r.seq: r.reason for r in rejected_frames(frames).collect()}
    assert reasons == {
        0: "empty",
        1: "other type",
        2: "too short",
        3: "too short",
        4: "bad text",
        5: "bad text",
        7: "too short",
    }


def test_text_is_stripped_like_python(spark):
    names = [b"\tAB \r\n", b" A B  ", " Ü".encode(), b"\x1cZ\x1f", b"\0Q", b"        "]
    _, got = _decoded(spark, *[directory(1, 1, n.ljust(8), b"Q") for n in names])
    assert [got[i].stock for i in range(len(names))] == [
        n.ljust(8).decode().strip() for n in names
    ]


def test_large_order_ref_and_latin_category(spark):
    _, got = _decoded(
        spark,
        order("A", 1, 1, 2**63, "B", 1, b"X", 1),
        order("A", 1, 1, 2**63 - 1, "B", 1, b"X", 1),
        directory(1, 1, b"X", b"\xe9"),
        directory(1, 1, b"X", b"Q") + b"longer payloads are fine",
    )
    assert got[0].order_ref is None and got[0].shares == 1
    assert got[1].order_ref == 2**63 - 1
    assert got[2].market_cat == "é" and got[3].market_cat == "Q"


def test_split_by_kind(spark):
    frames, _ = _decoded(
        spark,
        directory(1, 1, b"X", b"Q"),
        directory(1, 9, b"X", b"Q"),
        order("A", 1, 2, 1, "B", 1, b"X", 1),
        order("P", 1, 3, 1, "B", 1, b"X", 10000),
    )
    tape = decode_messages(frames)
    assert rows.directory(tape).count() == 1
    assert rows.trades(tape).count() == 1
    assert rows.add_orders(tape).count() == 1
    first = rows.trade_columns(tape)
    assert first.columns == ["stock_locate", "timestamp", "shares", "stock", "price"]
    assert tuple(first.first()) == (1, 3, 1, "X", 1.0)
    assert dict(first.dtypes)["stock_locate"] == "bigint"
    assert tape.filter(F.col("msg_type") == "X").isEmpty()
