"""Whole jobs on a small feed, checked against plain Python over the same messages."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tape import S, column, directory, frame, order
from tickloom import __main__ as command
from tickloom.operators import bars as bar_ops
from tickloom.plans import features, jobs, model, queries, sql_functions, tape_views
from tickloom.schema import BAR_SUMMARY, STOCK_SUMMARY
from tickloom.session import materialise, scratch_root
from tickloom.sources import sinks, tables

MINUTE = 60 * S
OPEN = 34_200 * S
DAY = "2020-01-30"


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    """Two files of one session; stock '7' is all digits, 'GHOST' has no directory row."""
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("feed")
    names = [b"AAPL", b"MSFT", b"7", b"GHOST"]
    messages, clock = [], OPEN
    heads = [directory(i, 1, n, c) for i, (n, c) in enumerate([(b"AAPL", b"Q"), (b"MSFT", b"Q"), (b"7", b"N"), (b"7", b"G")])]
    for part in range(2):
        out = b"".join(map(frame, heads)) if part == 0 else b""
        for _ in range(1_500):
            clock += rng.randrange(1, 200_000_000)
            i = rng.choice([0, 0, 0, 1, 1, 2, 3])
            kind = rng.choice("APPX")
            side, shares = rng.choice("BS"), rng.randrange(1, 500)
            ticks = 1_000_000 + rng.randrange(-5_000, 5_000)
            out += frame(order(kind, i, clock, 1, side, shares, names[i], ticks))
            messages.append((kind, i, names[i].decode(), clock, side, shares, ticks))
        (path / f"part{part}.bin").write_bytes(out)
    return str(path), messages


@pytest.fixture(scope="module")
def landed(spark, feed, tmp_path_factory):
    data = str(tmp_path_factory.mktemp("data"))
    jobs.land(spark, feed[0], data, DAY)
    jobs.compute_signals(spark, data)
    return data


def test_landed_messages(spark, feed, landed):
    tape = jobs.load_messages(spark, landed)
    counts = {r.msg_type: r["count"] for r in tape.groupBy("msg_type").count().collect()}
    kinds = [m[0] for m in feed[1]]
    assert counts == {"A": kinds.count("A"), "P": kinds.count("P"), "R": 4}
    hours = {r.hour for r in tape.filter("msg_type <> 'R'").select("hour").distinct().collect()}
    assert hours == {m[3] // (3600 * S) for m in feed[1]}
    assert tape.filter("stock = '7'").count() > 0


def test_landed_columns_and_days(spark, feed, tmp_path):
    data = str(tmp_path / "data")
    for day in (DAY, "2020-01-31", DAY):
        jobs.land(spark, feed[0], data, day)
    tape = jobs.load_messages(spark, data)
    assert {str(r.trade_date): r["count"] for r in tape.groupBy("trade_date").count().collect()} == dict.fromkeys(
        (DAY, "2020-01-31"), sum(m[0] != "X" for m in feed[1]) + 4
    )
    row = tape.where("msg_type = 'P' and trade_date = '2020-01-30'").orderBy("ts_ns").first()
    assert row.timestamp == row.ts_ns and row.hour == row.ts_ns // (3600 * S)
    assert str(row.readable_time).startswith(f"{DAY} {row.hour:02d}:")
    assert tape.select("trade_date", "seq").distinct().count() == tape.count()
    bars_ = bar_ops.minute_bars(jobs.load_enriched(spark, data))
    one = bar_ops.minute_bars(jobs.load_enriched(spark, data).where("trade_date = '2020-01-30'"))
    assert bars_.count() == 2 * one.count()


def test_a_failed_landing_leaves_the_day(spark, feed, tmp_path, monkeypatch):
    """The trades fail after the messages are written: neither table changes."""
    data = str(tmp_path / "data")
    jobs.land(spark, feed[0], data, DAY)
    before = jobs.load_messages(spark, data).count(), jobs.load_enriched(spark, data).count()
    half = tmp_path / "half"
    half.mkdir()
    (half / "part0.bin").write_bytes(open(f"{feed[0]}/part0.bin", "rb").read())

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(jobs.joins, "enrich_trades", broken)
        with pytest.raises(RuntimeError):
            jobs.land(spark, str(half), data, DAY)
    assert (jobs.load_messages(spark, data).count(), jobs.load_enriched(spark, data).count()) == before
    jobs.land(spark, str(half), data, DAY)
    after = jobs.load_messages(spark, data).count(), jobs.load_enriched(spark, data).count()
    assert all(0 < a < b for a, b in zip(after, before))
    # The version before stays, what the failed landing left is gone.
    assert len(list((tmp_path / "data" / jobs.MESSAGES / f"trade_date={DAY}").iterdir())) == 2


def test_signals_of_one_day_leave_the_others(spark, feed, tmp_path):
    data = tmp_path / "data"
    for day in (DAY, "2020-01-31"):
        jobs.land(spark, feed[0], str(data), day)
        command.main(["signals", "--date", day, "--data", str(data)])
    names = (jobs.BARS_CSV, jobs.STOCKS_CSV, jobs.VWAPS, *[f"{jobs.SIGNALS}/{n}" for n in ("obi", "market_impact", "volatility")])

    def files(day):
        return {str(f): f.stat().st_mtime_ns for n in names for f in (data / n / f"trade_date={day}").iterdir()}

    kept = files(DAY)
    jobs.compute_signals(spark, str(data), "2020-01-31")
    assert files(DAY) == kept
    totals = jobs.load_vwap(spark, str(data)).groupBy("trade_date").agg(F.sum("total_volume")).collect()
    assert len(totals) == 2 and totals[0][1] == totals[1][1]


def test_scratch_is_emptied(spark, feed, tmp_path):
    import os

    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    command.main(["all", "--feed", feed[0], "--date", DAY, "--data", str(tmp_path / "out")])
    assert {n for n in set(os.listdir(root)) - before if not n.startswith("rdd-")} == set()


def test_partition_filter_prunes(spark, landed):
    plan = jobs.load_messages(spark, landed).filter("msg_type = 'P'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(msg_type" in text


def test_enriched_trades(spark, feed, landed):
    got = jobs.load_enriched(spark, landed)
    per_stock = defaultdict(int)
    for kind, _, stock, *_ in feed[1]:
        if kind == "P":
            per_stock[stock] += 1
    wanted = {"AAPL": per_stock["AAPL"], "MSFT": per_stock["MSFT"], "7": 2 * per_stock["7"]}
    assert {r.stock: r["count"] for r in got.groupBy("stock").count().collect()} == wanted


def test_bar_summary(spark, feed, landed):
    got, _ = jobs.load_summaries(spark, landed)
    volume, value, prices = defaultdict(int), defaultdict(int), defaultdict(list)
    for kind, _, stock, ts, _, shares, ticks in feed[1]:
        for category in {"AAPL": "Q", "MSFT": "Q", "7": "NG", "GHOST": ""}[stock]:
            if kind == "P":
                key = (stock, ts // MINUTE, category)
                volume[key] += shares
                value[key] += shares * ticks
                prices[key].append(ticks / 10_000)
    rows = {(r.stock, r.minute_bucket, r.market_cat): r for r in got.collect()}
    assert set(rows) == set(volume)
    for key, r in rows.items():
        assert (r.volume, r.trade_count) == (volume[key], len(prices[key]))
        assert math.isclose(r.vwap, value[key] / volume[key] / 10_000)
        assert math.isclose(r.avg_price, sum(prices[key]) / len(prices[key]))


def test_stock_summary_and_read_queries(spark, landed):
    bars_table, stocks_table = jobs.load_summaries(spark, landed)
    enriched = jobs.load_enriched(spark, landed)
    vwaps = {(r.stock, r.market_cat): r.total_volume for r in jobs.load_vwap(spark, landed).collect()}
    assert vwaps == {(r.stock, r.market_cat): r.total_volume for r in stocks_table.collect()}
    assert sorted(map(tuple, stocks_table.collect())) == sorted(
        map(tuple, queries.q_summary(enriched).collect())
    )
    assert [r.stock for r in queries.q_tickers(enriched).collect()] == ["7", "AAPL", "MSFT"]
    total = bars_table.agg(F.sum("volume")).first()[0]
    assert total == stocks_table.agg(F.sum("total_volume")).first()[0]
    candles = queries.q_candles(enriched, "AAPL").collect()
    assert [c.minute_bucket for c in candles] == sorted(c.minute_bucket for c in candles)
    for c in candles:
        assert c.low <= min(c.open, c.close, c.vwap) and max(c.open, c.close, c.vwap) <= c.high


def test_imbalance(spark, feed, landed):
    book = defaultdict(lambda: [0, 0])
    for kind, _, stock, ts, side, shares, _ in feed[1]:
        if kind == "A":
            book[stock, ts // MINUTE][side == "S"] += shares
    got = jobs.load_imbalance(spark, landed)
    rows = {(r.stock, r.minute_bucket): r for r in got.collect()}
    assert {k: [r.Buy_Vol, r.Sell_Vol] for k, r in rows.items()} == dict(book)
    for key, (buy, sell) in book.items():
        assert math.isclose(rows[key].OBI, (buy - sell) / (buy + sell))
        assert -1 <= rows[key].OBI <= 1
    series = queries.q_obi_series(got, "MSFT").collect()
    assert [r.minute_bucket for r in series] == sorted(m for s, m in book if s == "MSFT")
    newest = max(m for s, m in book if s == "MSFT")
    score = queries.q_sentiment(jobs.load_enriched(spark, landed), got, "MSFT").first()
    assert math.isclose(score.sentiment_score, 50 + 50 * rows["MSFT", newest].OBI)


def test_market_impact(spark, feed, landed):
    got = spark.read.parquet(f"{landed}/{jobs.SIGNALS}/market_impact")
    last, wanted = {}, {}
    for kind, locate, _, ts, _, _, ticks in feed[1]:
        if kind == "A":
            last[locate] = ticks / 10_000
        elif kind == "P":
            wanted[ts] = last.get(locate)
    assert column(got, "ts_ns", "last_a_price") == wanted


def test_volatility_covers_all_trades(spark, feed, landed):
    got = spark.read.parquet(f"{landed}/{jobs.SIGNALS}/volatility")
    assert got.count() == sum(m[0] == "P" for m in feed[1])
    window = "partition by stock order by ts_ns range between 300000000000 preceding and current row"
    got.createOrReplaceTempView("volatility_table")
    off = spark.sql(
        f"""select * from (select volatility, stddev(price) over ({window}) as plain
            from volatility_table) where abs(volatility - plain) > 1e-9
            or (volatility is null) <> (plain is null)"""
    )
    assert off.isEmpty()


def test_features_against_plain_windows(spark, landed):
    tape = jobs.load_messages(spark, landed)
    got = features.build_features(tape, top=2)
    tape.createOrReplaceTempView("tape")
    spark.sql(
        """
        create or replace temp view plain as
        with leaders as (select stock from (select stock, sum(shares) v from tape
              where msg_type = 'P' group by stock) order by v desc, stock limit 2),
          s as (select *, ts_ns div 1000000000 as sec from tape
              where stock in (select stock from leaders)),
          obi as (select stock, sec div 60 as m,
              sum(if(side = 'B', shares, -shares)) / (sum(shares) + 1e-9) as obi
              from s where msg_type = 'A' group by 1, 2),
          t as (select s.*, coalesce(obi.obi, 0.0) as obi from s left join obi
              on s.stock = obi.stock and s.sec div 60 = obi.m where msg_type = 'P'),
          w as (select *, stddev(price) over r as sd, count(price) over r as n,
              sum(price * shares) over r / sum(shares) over r as vw,
              max(price) over (partition by stock order by sec
                range between 1 following and 30 following) as ahead
              from t window r as (partition by stock order by sec
                range between 60 preceding and current row))
        select stock, sec, obi, sd, n,
          vw - lag(vw) over (partition by stock order by ts_ns, seq) as dv,
          if(ahead > price, 1.0D, 0.0D) as label from w
        """
    )
    plain = spark.table("plain").dropna()

    def rounded(df):
        return sorted(
            tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)
            for row in df.collect()
        )

    assert got.columns == ["trade_date", "stock", "timestamp_sec", *features.FEATURES, features.LABEL]
    assert rounded(got.drop("trade_date")) == rounded(plain)
    assert not got.isEmpty()


def test_lagged_imbalance_differs(spark, landed):
    tape = jobs.load_messages(spark, landed)
    now = features.build_features(tape, top=2).select("OBI").distinct().count()
    before = features.build_features(tape, top=2, obi_lag=1)
    assert before.filter("OBI = 0.0").count() > 0 and now > 1


def test_metrics_of_a_confusion_table():
    table = [(0.0, 0.0, 6), (0.0, 1.0, 2), (1.0, 0.0, 3), (1.0, 1.0, 4), (2.0, 0.0, 1)]
    found = model.evaluate([{"label": a, "prediction": b, "n": n} for a, b, n in table])
    assert math.isclose(found["accuracy"], 10 / 16)
    assert math.isclose(found["weightedPrecision"], (8 * 6 / 10 + 7 * 4 / 6) / 16)
    assert model.evaluate([]) == {"accuracy": 0.0, "weightedPrecision": 0.0}


def test_model_is_repeatable(spark, landed):
    first, second = jobs.train(spark, landed), jobs.train(spark, landed)
    assert first.metrics == second.metrics
    assert all(0.0 <= v <= 1.0 for v in first.metrics.values())
    assert first.model.getNumTrees == model.TREES
    table = model.confusion(first.predictions)
    right = table.filter("label = prediction").agg(F.sum("n")).first()[0]
    every = table.agg(F.sum("n")).first()[0]
    assert math.isclose(right / every, first.metrics["accuracy"])


def test_split_is_chronological(spark):
    rows = spark.range(100).select(F.col("id").alias("timestamp_sec"))
    train, test = model.chrono_split(rows)
    assert train.agg(F.max("timestamp_sec")).first()[0] < test.agg(F.min("timestamp_sec")).first()[0]
    assert (train.count(), test.count()) == (80, 20)


def test_no_complete_features(spark, landed):
    empty = features.build_features(jobs.load_messages(spark, landed).limit(0))
    with pytest.raises(ValueError):
        model.fit_and_evaluate(empty)


def test_command_line(spark, feed, tmp_path, capsys):
    command.main(["all", "--feed", feed[0], "--date", DAY, "--data", str(tmp_path / "out")])
    assert "Test accuracy" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        command.main(["land", "--data", str(tmp_path)])


# --- sources and sinks -------------------------------------------------------


def test_missing_summary_is_empty(spark, tmp_path):
    table = tables.scan_summary_csv(spark, str(tmp_path / "none.csv"), BAR_SUMMARY)
    assert table.schema == BAR_SUMMARY and table.isEmpty()
    assert all(t.isEmpty() for t in jobs.load_summaries(spark, str(tmp_path)))


def test_summary_csv_keeps_order_and_values(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    rows = [(f"S{i}", "Q,\"x\"", 10**12 - i, i / 3, i) for i in range(50)]
    table = spark.createDataFrame(rows, STOCK_SUMMARY).repartition(4)
    sinks.write_summary_csv(table.orderBy(F.desc("total_volume")), path)
    back = tables.scan_summary_csv(spark, path, STOCK_SUMMARY)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_numeric_tickers_stay_text(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("1", "P", 9, 1), ("2", "P", 9, 2), ("007", "P", 9, 3)]
    table = spark.createDataFrame(rows, "stock string, msg_type string, hour int, ts_ns bigint")
    sinks.write_partitioned(table, path, ("stock", "msg_type", "hour"))
    back = tables.scan_parquet(spark, path, table.schema)
    assert sorted(map(tuple, back.select(*table.columns).collect())) == sorted(rows)
    assert back.filter("stock = '007'").count() == 1


LEGACY = "stock string, time bigint, shares bigint, price double"


@pytest.mark.parametrize("given", [(), ("volume",), ("minute_bucket",), ("market_cat",)])
def test_legacy_columns_only_where_missing(spark, given):
    raw = spark.createDataFrame(
        [("X", 30, 1, 1.0), ("X", 10, 2, 2.0), (None, 20, 3, 3.0)], LEGACY
    )
    for name in given:
        raw = raw.withColumn(name, F.lit("kept"))
    out = tables.normalise_legacy(raw)
    for name, values in {
        "volume": {30: 1, 10: 2, 20: 3},
        "minute_bucket": {30: 2, 10: 0, 20: 1},
        "market_cat": dict.fromkeys((10, 20, 30), "Unknown"),
    }.items():
        wanted = dict.fromkeys((10, 20, 30), "kept") if name in given else values
        assert column(out, "time", name) == wanted


def test_legacy_ties_are_determined(spark):
    rows = [("X", 10, 2, 2.0), ("A", 10, 1, 1.0), ("X", 10, 1, 5.0), ("B", 5, 9, 1.0)]
    wanted = {("B", 9): 0, ("A", 1): 1, ("X", 1): 2, ("X", 2): 3}
    for given in (rows, rows[::-1]):
        table = tables.normalise_legacy(spark.createDataFrame(given, LEGACY).repartition(3))
        assert {(r.stock, r.shares): r.minute_bucket for r in table.collect()} == wanted


def test_legacy_without_time_or_shares(spark):
    raw = spark.createDataFrame([("X", 1.0)], "stock string, price double")
    assert tables.normalise_legacy(raw).columns == ["stock", "price", "market_cat"]


def test_legacy_summary_drops_null_stocks(spark):
    from tickloom.operators.bars import legacy_stock_summary

    raw = spark.createDataFrame(
        [("X", 1, 1, 1.0), ("X", 2, 5, None), (None, 3, 3, 3.0)], LEGACY
    )
    got = legacy_stock_summary(tables.normalise_legacy(raw)).collect()
    assert [tuple(r) for r in got] == [("X", "Unknown", 6, 1.0, 2)]


def test_preview(spark, capsys):
    sinks.preview(spark.range(9), 2)
    assert "only showing top 2 rows" in capsys.readouterr().out


def test_scratch_and_materialise(spark, sf_dir):
    assert scratch_root(spark) == scratch_root(spark)
    frames = materialise(tape_views.frames(spark, sf_dir), "frames")
    assert frames.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_table_functions_equal_the_queries(spark, landed):
    sql_functions.register_landed(spark, landed)
    enriched, obi = jobs.load_enriched(spark, landed), jobs.load_imbalance(spark, landed)

    def called(call, **args):
        return sorted(map(tuple, spark.sql(f"select * from {call}", args=args).collect()))

    def plain(df):
        return sorted(map(tuple, df.collect()))

    assert called("q_tickers()") == plain(queries.q_tickers(enriched))
    assert called("q_summary()") == plain(queries.q_summary(enriched))
    for stock in ("AAPL", "7"):
        for name, form in (
            ("q_candles", queries.q_candles(enriched, stock)),
            ("q_obi_series", queries.q_obi_series(obi, stock)),
            ("q_sentiment", queries.q_sentiment(enriched, obi, stock)),
        ):
            assert called(f"{name}(stock => :s)", s=stock) == plain(form)
    assert called("q_candles()") == plain(queries.q_candles(enriched))
    assert called("q_candles(:s)", s="AAPL' or '1' = '1") == []
    plan = spark.sql("select * from q_candles(stock => :s)", args={"s": "AAPL"})._jdf.queryExecution()
    assert "EqualTo(stock,AAPL)" in plan.executedPlan().toString()
