"""Streams lose no row: late files, late days, and the newest bar."""

import random

import pytest

from tape import S, directory, frame, order
from tickloom.operators import bars, rows, signals
from tickloom.schema import MESSAGES, REJECTED
from tickloom.sources import commits, frames
from tickloom.sources.messages import decode_messages, rejected_frames
from tickloom.streaming import live, partial

HOUR = 3600 * S


def _file(path, *trades):
    data = b"".join(frame(order("P", 1, ts, 1, "B", shares, b"AAPL", 10_000)) for ts, shares in trades)
    path.write_bytes(data + frame(b"Xother"))


def _land(spark, folder, decode=decode_messages, **options):
    return live.land_feed(spark, str(folder / "feed"), str(folder / "out"), str(folder / "checkpoint"), decode, **options)


def _landed(spark, folder):
    _land(spark, folder)
    return live.landed(spark, str(folder / "out"), MESSAGES)


def _volumes(landed):
    table = bars.minute_bars(rows.trades(landed).selectExpr("*", "'Q' as market_cat"), bar_ns=HOUR)
    return {r.minute_bucket: r.volume for r in table.collect()}


def test_an_older_second_file_counts(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    _file(tmp_path / "feed" / "a.bin", *[(h * HOUR, 100) for h in range(9, 17)])
    assert _volumes(_landed(spark, tmp_path)) == dict.fromkeys(range(9, 17), 100)
    _file(tmp_path / "feed" / "b.bin", *[(h * HOUR + 1, 50) for h in range(8, 12)])
    wanted = {8: 50} | {h: 150 for h in range(9, 12)} | {h: 100 for h in range(12, 17)}
    assert _volumes(_landed(spark, tmp_path)) == wanted
    assert _landed(spark, tmp_path).count() == 12


def test_refused_frames_are_counted(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    _file(tmp_path / "feed" / "a.bin", (9 * HOUR, 1))
    assert _land(spark, tmp_path, rejected_frames) and _land(spark, tmp_path, rejected_frames) is None
    assert [r.reason for r in live.landed(spark, str(tmp_path / "out"), REJECTED).collect()] == ["other type"]


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    _file(tmp_path / "feed" / "a.bin", *[(h * HOUR + i, 1) for h in range(9, 17) for i in range(2_000)])
    run = _land(spark, tmp_path, range_bytes=frames.SMALLEST_RANGE)
    files = list((tmp_path / "out" / "rows" / f"run={run}").glob("*.parquet"))
    assert len(files) > 1
    assert live.landed(spark, str(tmp_path / "out"), MESSAGES).count() == 16_000


def test_a_failed_run_is_made_up_for(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    _file(tmp_path / "feed" / "a.bin", (9 * HOUR, 1))

    def broken(table):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        _land(spark, tmp_path, broken)
    assert live.landed(spark, str(tmp_path / "out"), MESSAGES).count() == 0
    _file(tmp_path / "feed" / "b.bin", (10 * HOUR, 1))
    assert _landed(spark, tmp_path).count() == 2


def _plain(df):
    return sorted(tuple(r.asDict().values()) for r in df.collect())


def test_sums_of_runs_equal_a_batch(spark, tmp_path):
    """Three runs, the last with late rows; folded after the second."""
    rng = random.Random(4)
    (tmp_path / "feed").mkdir()
    kinds = (partial.BARS, partial.IMBALANCE, partial.CANDLES)
    for run in range(3):
        data = frame(directory(1, 1, b"AAPL", b"Q")) + frame(directory(1, 1, b"AAPL", b"N")) if not run else b""
        for i in range(300):
            ts = rng.randrange(9 * HOUR, 12 * HOUR)
            side, ticks = rng.choice("BS"), 10_000 + rng.randrange(100)
            data += frame(order(rng.choice("AP"), 1, ts, i, side, rng.randrange(1, 9), rng.choice([b"AAPL", b"X"]), ticks))
        (tmp_path / "feed" / f"{run}.bin").write_bytes(data)
        _land(spark, tmp_path)
        for kind in kinds:
            path = str(tmp_path / kind.name)
            live.update_sums(spark, kind, str(tmp_path / "out"), MESSAGES, path, HOUR)
            live.update_sums(spark, kind, str(tmp_path / "out"), MESSAGES, path, HOUR)  # adds nothing
            if run == 1:
                live.compact(spark, kind, path)
                assert len(commits.committed(spark, path)) == 1
    tape = live.landed(spark, str(tmp_path / "out"), MESSAGES)
    sums = {k.name: live.summed(spark, k, str(tmp_path / k.name)) for k in kinds}
    book = rows.directory(tape)
    assert _plain(partial.BARS.finish(sums["bars"], book)) == _plain(bars.minute_bars(rows.trades(tape), book, HOUR))
    assert _plain(partial.IMBALANCE.finish(sums["imbalance"])) == _plain(
        signals.order_book_imbalance(rows.add_orders(tape), HOUR)
    )
    assert _plain(partial.CANDLES.finish(sums["candles"])) == _plain(bars.ohlc_candles(rows.trades(tape), HOUR))


def test_a_run_sums_its_own_rows_only(spark, tmp_path):
    """The second part of the sums has the bars of the second run and no others."""
    (tmp_path / "feed").mkdir()
    path = str(tmp_path / "sums")
    for name, hour in (("a", 9), ("b", 10)):
        _file(tmp_path / "feed" / f"{name}.bin", (hour * HOUR, 5))
        _land(spark, tmp_path)
        live.update_sums(spark, partial.CANDLES, str(tmp_path / "out"), MESSAGES, path, HOUR)
    parts = [spark.read.parquet(f"{path}/part={n}") for n in commits.committed(spark, path)]
    assert [[r.minute_bucket for r in p.collect()] for p in parts] == [[9], [10]]


def test_refresh_replaces_touched_days_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    tape = spark.createDataFrame(
        [("2020-01-30", "X", 1, 5, 10_000, "Q"), ("2020-01-31", "X", 1, 7, 10_000, "Q")],
        "trade_date string, stock string, ts_ns bigint, shares bigint, price_ticks bigint, market_cat string",
    ).selectExpr("* except (trade_date)", "cast(trade_date as date) as trade_date")
    bar = lambda df: bars.minute_bars(df, ordered=False)
    live.refresh(tape, bar, path, ["2020-01-30", "2020-01-31"])
    live.refresh(tape.union(tape), bar, path, ["2020-01-31"])
    found = {str(r.trade_date): r.volume for r in spark.read.parquet(path).collect()}
    assert found == {"2020-01-30": 5, "2020-01-31": 14}
