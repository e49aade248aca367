import math
import statistics

import pytest
from pyspark.sql import functions as F

from tape import ADD, S, adds, bars, column, trades
from tickloom.operators import bars as bar_ops
from tickloom.operators import joins, reports, rows, signals
from tickloom.schema import BAR_SUMMARY

DIR = "stock_locate int, stock string, market_cat string"
MSG = (
    "msg_type string, stock_locate int, stock string, ts_ns bigint, seq bigint, side string, "
    "shares bigint, price_ticks bigint, price double, market_cat string, order_ref bigint"
)


def message(kind, ts, seq, price, locate=1, side="B", shares=100, stock="X"):
    return (
        kind, locate, stock, ts, seq, side, shares, round(price * 10000), float(price), None, None,
    )


# --- joins -------------------------------------------------------------------


@pytest.mark.parametrize("salts", [None, 4])
def test_enrich_drops_and_repeats(spark, salts):
    tape = trades(spark, ("X", 1, 1, 10, 5), ("X", 2, 2, 20, 6), ("Y", 3, 3, 30, 7))
    directory = spark.createDataFrame([(1, "X", "Q"), (2, "X", "Q"), (1, "X", "G")], DIR)
    got = joins.enrich_trades(tape, directory, salts=salts)
    assert sorted((r.seq, r.stock_locate, r.market_cat) for r in got.collect()) == [
        (1, 1, "G"), (1, 1, "Q"), (1, 2, "Q"), (2, 1, "G"), (2, 1, "Q"), (2, 2, "Q"),
    ]


def test_sums_per_category_equal_joined_rows(spark):
    tape = trades(
        spark, ("X", 1, 1, 10, 5.5), ("X", 2, 2, 20, 6), ("Y", 3, 3, 30, 7), ("Z", 4, 4, 1, 1)
    )
    directory = spark.createDataFrame(
        [(1, "X", "Q"), (2, "X", "Q"), (1, "X", "G"), (5, "Y", None)], DIR
    )
    joined = joins.enrich_trades(tape, directory)
    for operator in (bar_ops.minute_bars, bar_ops.vwap_by_stock, bar_ops.stock_summary):
        direct = sorted(map(repr, operator(tape, directory).collect()))
        assert direct == sorted(map(repr, operator(joined).collect()))
    summary = bar_ops.stock_summary(tape, directory).collect()
    assert (summary[0].stock, summary[0].market_cat, summary[0].total_volume) == ("X", "Q", 60)
    assert summary[0].trade_count == 4 and summary[0].avg_price == 5.75


def test_directory_latest(spark):
    tape = spark.createDataFrame(
        [("R", 1, "X", 5, 1, "Q"), ("R", 2, "X", 5, 2, "G"), ("R", 3, "X", 4, 9, "S")],
        "msg_type string, stock_locate int, stock string, ts_ns bigint, seq bigint, "
        "market_cat string",
    )
    assert [tuple(r) for r in joins.directory_latest(tape).collect()] == [(2, "X", "G")]


def test_last_quote_ties_follow_file_order(spark):
    tape = spark.createDataFrame(
        [
            message("P", 5, 0, 9.0),
            message("A", 10, 1, 10.0),
            message("P", 10, 2, 10.5),
            message("A", 10, 3, 11.0),
            message("P", 10, 4, 10.5),
            message("P", 99, 5, 12.0),
            message("P", 99, 6, 3.0, locate=2),
        ],
        MSG,
    )
    for slice_ns in (1, 7, 1_000):
        got = joins.market_impact(tape, ("seq",), slice_ns=slice_ns)
        assert column(got, "seq", "last_a_price") == {
            0: None, 2: 10.0, 4: 11.0, 5: 11.0, 6: None,
        }
        assert column(got, "seq", "market_impact")[4] == -0.5


def test_last_quote_by_side(spark):
    tape = spark.createDataFrame(
        [
            message("A", 1, 1, 10.0, side="B"),
            message("A", 2, 2, 11.0, side="S"),
            message("P", 3, 3, 10.5, side="B"),
        ],
        MSG,
    )
    assert column(joins.market_impact(tape, ("seq",)), "seq", "last_a_price") == {3: 11.0}
    by_side = joins.market_impact(tape, ("seq",), by_side=True)
    assert column(by_side, "seq", "last_a_price") == {3: 10.0}


def test_top_k_ties_by_name(spark):
    names = [f"S{i:02d}" for i in range(11)]
    tape = trades(spark, *[(n, i, i, 100, 1) for i, n in enumerate(reversed(names))], ("", 1, 9, 999, 1))
    top = bar_ops.top_by_volume(tape, 10)
    assert [r.stock for r in top.collect()] == names[:10]
    assert {r.stock for r in joins.keep_top(tape, top).collect()} == set(names[:10])


def test_attach_imbalance(spark):
    tape = rows.with_bucket(trades(spark, ("X", 61 * S, 1, 1, 1), ("X", 200 * S, 2, 1, 1)))
    obi = signals.order_book_imbalance(adds(spark, ("X", 119 * S, 1, "B", 3, 1), ("X", 60 * S, 2, "S", 1, 1)))
    assert column(joins.attach_imbalance(tape, obi), "seq", "OBI") == {1: 0.5, 2: 0.0}


# --- aggregations ------------------------------------------------------------


def test_candles_open_and_close_by_place_in_file(spark):
    tape = trades(
        spark, ("X", 5, 3, 1, 3), ("X", 5, 1, 2, 1), ("X", 4, 9, 1, 2), ("X", 5, 2, 1, 9)
    ).repartition(3)
    candle = bar_ops.ohlc_candles(tape).first()
    assert (candle.open, candle.high, candle.low, candle.close) == (2.0, 9.0, 1.0, 3.0)
    assert candle.volume == 5 and math.isclose(candle.vwap, 16 / 5)


def test_zero_volume_bar(spark):
    bar = bar_ops.minute_bars(
        trades(spark, ("X", 1, 1, 0, 5)).withColumn("market_cat", F.lit("Q"))
    ).first()
    assert (bar.volume, bar.vwap, bar.avg_price, bar.trade_count) == (0, None, 5.0, 1)


def test_imbalance_of_empty_books(spark):
    book = adds(
        spark,
        ("X", 0, 1, "B", 0, 1),
        ("X", 1, 2, "S", 0, 1),
        ("Y", 0, 3, "X", 50, 1),
        ("Z", 0, 4, "B", 10, 1),
    )
    assert column(signals.order_book_imbalance(book), "stock", "OBI") == {
        "X": None, "Y": None, "Z": 1.0,
    }
    eps = column(signals.order_book_imbalance_eps(book), "stock", "OBI")
    assert eps["X"] == 0.0 and eps["Y"] == 0.0 and math.isclose(eps["Z"], 1.0)
    status = reports.sentiment(book, signals.order_book_imbalance(book))
    assert column(status, "stock", "sentiment_score") == {"X": 50.0, "Y": 50.0, "Z": 100.0}
    assert column(status, "stock", "status") == {"X": "NEUTRAL", "Y": "NEUTRAL", "Z": "BULLISH"}


def test_sentiment_without_orders(spark):
    stocks = spark.createDataFrame([("N",), ("N",)], "stock string")
    none = signals.order_book_imbalance(spark.createDataFrame([], ADD))
    got = reports.sentiment(stocks, none).collect()
    assert [(r.obi, r.sentiment_score, r.status) for r in got] == [(0.0, 50.0, "NEUTRAL")]


# --- windows -----------------------------------------------------------------


def test_volatility_frame_is_inclusive(spark):
    tape = trades(
        spark, ("X", 0, 1, 1, 1), ("X", 300 * S, 2, 1, 2), ("X", 300 * S, 3, 1, 4), ("X", 600 * S + 1, 4, 1, 9)
    )
    got = column(signals.rolling_volatility(tape), "seq", "volatility")
    both = statistics.stdev([1, 2, 4])
    assert math.isclose(got[2], both) and math.isclose(got[3], both)
    assert got[1] is None and got[4] is None


def test_second_statistics(spark):
    tape = trades(
        spark,
        ("X", 0, 1, 10, 1.0),
        ("X", 60 * S, 2, 10, 3.0),
        ("X", 60 * S + 5, 3, 20, 5.0),
        ("X", 61 * S, 4, 10, 2.0),
        ("X", 90 * S, 5, 10, 4.0),
        ("X", 92 * S, 6, 10, 1.0),
    )
    got = {r.seq: r for r in signals.rolling_trade_stats(tape).collect()}
    # -60..0 covers 61 second values, trades of the own second included.
    assert [got[i].Trade_Count_Per_Min for i in range(1, 7)] == [1, 3, 3, 3, 4, 5]
    assert math.isclose(got[2].VWAP, (10 + 30 + 100) / 40)
    assert got[1].VWAP_prev is None
    assert got[2].VWAP_prev == got[1].VWAP and got[3].VWAP_prev == got[3].VWAP
    assert got[3].VWAP_Change == 0.0
    assert math.isclose(got[3].Rolling_Volatility, statistics.stdev([1, 3, 5]))
    # +1..+30 skips the own second and includes second 30.
    assert got[1].Future_Max_Price is None and got[1].price_direction == 0.0
    assert got[2].Future_Max_Price == 4.0 and got[2].price_direction == 1.0
    assert got[3].Future_Max_Price == 4.0 and got[3].price_direction == 0.0
    assert got[4].Future_Max_Price == 4.0 and got[4].price_direction == 1.0
    assert got[6].Future_Max_Price is None


# --- reports -----------------------------------------------------------------


@pytest.fixture(scope="module")
def short(spark):
    return bars(
        spark,
        ("one", 1, "Q", 5, 10),
        ("two", 1, "Q", 5, 10), ("two", 2, "Q", 5, 20),
        ("three", 1, "Q", 1, 100), ("three", 2, "Q", 1, 101), ("three", 3, "Q", 1, 101),
        ("zero", 1, "Q", 1, 0), ("zero", 2, "Q", 1, 5), ("zero", 3, "Q", 9, 6),
        ("pair", 1, "Q", 1, 10), ("pair", 1, "G", 1, 20), ("pair", 2, "G", 1, 30),
    )


def test_regimes(short):
    got = {r.stock: r for r in reports.bar_return_volatility(short).collect()}
    assert got["one"].volatility == 0.0 and got["one"].regime == "NORMAL"
    assert got["two"].volatility is None and got["two"].regime == "NORMAL"
    assert math.isclose(got["three"].volatility, statistics.stdev([0.01, 0.0]))
    assert got["three"].regime == "NORMAL"
    assert got["zero"].volatility is None and got["zero"].regime == "NORMAL"
    # Categories of one bar are bars of their own: 20, 10, 30.
    assert math.isclose(got["pair"].volatility, statistics.stdev([-0.5, 2.0]))
    assert got["pair"].regime == "HIGH"


@pytest.mark.parametrize("v,regime", [(0.0, "NORMAL"), (0.01, "NORMAL"), (0.011, "ELEVATED"), (0.02, "ELEVATED"), (0.021, "HIGH")])
def test_regime_limits(spark, v, regime):
    assert spark.range(1).select(reports.volatility_regime(F.lit(v))).first()[0] == regime


def test_abnormal_volume(short):
    total = column(reports.abnormal_volume(short), "stock", "abnormal")
    assert total == {"one": False, "two": False, "three": True, "zero": True, "pair": True}
    last = column(reports.abnormal_volume(short, "last_bar"), "stock", "abnormal")
    assert last == {"one": False, "two": False, "three": False, "zero": True, "pair": False}


def test_session_change(short):
    got = {r.stock: r for r in reports.session_change(short).collect()}
    assert (got["two"].price_change, got["two"].price_change_pct) == (10.0, 100.0)
    assert (got["zero"].price_change, got["zero"].price_change_pct) == (6.0, 0.0)
    assert got["pair"].first_price == 20.0 and got["pair"].last_price == 30.0
    assert got["zero"].direction == "▲"


@pytest.mark.parametrize("turned", [False, True])
def test_session_orders_whole_categories(spark, turned):
    """Two bars of one time whose categories agree in their first letters."""
    given = [
        ("X", 5, "STANDARD ANODIZED TIN", 1, 1.0, 1.0, 1),
        ("X", 5, "STANDARD BRUSHED TIN", 1, 2.0, 2.0, 1),
        ("Y", 5, None, 1, 3.0, 3.0, 1),
        ("Y", 5, "A", 1, 4.0, 4.0, 1),
    ]
    table = spark.createDataFrame(given[::-1] if turned else given, BAR_SUMMARY).coalesce(1)
    found = {r.stock: (r.first_price, r.last_price) for r in reports.session_change(table).collect()}
    assert found == {"X": (1.0, 2.0), "Y": (3.0, 4.0)}
    plan = reports.session_change(table)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_key_metric_labels(spark):
    table = bars(spark, ("x", 1, "Q", 1_000, 10), ("x", 2, "Q", 500, 7.5))
    label = reports.key_metric_labels(reports.key_metrics(table)).first()
    assert tuple(label) == ("x", "X", "$7.50", "▼ 25.00%", "1,500", "$7.50", "2")


def test_tape_scopes(spark):
    table = bars(spark, *[("X", m, "Q", 1, p) for m, p in enumerate([1, 2, 2, 1, 5])])
    tail = column(reports.trade_tape(table, 3), "minute_bucket", "direction")
    full = column(reports.trade_tape(table, 3, "full"), "minute_bucket", "direction")
    assert tail == {2: "●", 3: "▼", 4: "▲"}
    assert full == {2: "●", 3: "▼", 4: "▲"}
    first = column(reports.trade_tape(table, 4), "minute_bucket", "direction")
    assert first[1] == "●"
    assert column(reports.trade_tape(table, 4, "full"), "minute_bucket", "direction")[1] == "▲"
    assert column(reports.last_n_bars(table, 2), "minute_bucket", "idx") == {3: 0, 4: 1}


def test_depth_ladder(spark):
    book = adds(
        spark,
        ("X", 1, 1, "B", 10, 9.99), ("X", 2, 2, "B", 5, 9.99), ("X", 3, 3, "B", 1, 9.98),
        ("X", 4, 4, "S", 7, 10.01), ("X", 5, 5, "S", 8, 10.02), ("X", 6, 6, "S", 9, 10.03),
        ("X", 7, 7, "?", 9, 10.00),
    )
    got = column(reports.depth_ladder(book, 2), "side", "level", "price", "size")
    assert got == {
        ("B", 1, 9.99): 15, ("B", 2, 9.98): 1, ("S", 1, 10.01): 7, ("S", 2, 10.02): 8,
    }


def test_depth_ladder_by_bar(spark):
    """Bids 9.99 and 9.98 leave the two best when 10.00 and 9.995 come; the size of a level grows on."""
    book = adds(
        spark,
        ("X", 1, 1, "B", 10, 9.99), ("X", 2, 2, "B", 5, 9.98), ("X", 60 * S, 3, "B", 1, 9.99),
        ("X", 61 * S, 4, "B", 2, 10.0), ("X", 120 * S, 5, "B", 3, 9.995), ("X", 120 * S, 6, "B", 4, 9.98),
        ("X", 5, 7, "S", 7, 10.01), ("Y", 9, 8, "B", 6, 9.0), ("X", 6, 9, "?", 1, 1.0),
    )
    got = column(reports.depth_ladder_by_bar(book, 2), "stock", "side", "minute_bucket", "level", "price", "size")
    assert got == {
        ("X", "B", 0, 1, 9.99): 10, ("X", "B", 0, 2, 9.98): 5,
        ("X", "B", 1, 1, 10.0): 2, ("X", "B", 1, 2, 9.99): 11,
        ("X", "B", 2, 1, 10.0): 2, ("X", "B", 2, 2, 9.995): 3,
        ("X", "S", 0, 1, 10.01): 7, ("Y", "B", 0, 1, 9.0): 6,
    }


def test_session_phase_hours(spark):
    hour = 3600 * S
    tape = trades(spark, *[("X", h * hour, h, 1, 1) for h in (8, 9, 16, 17)])
    assert column(reports.session_phase(tape), "hour", "phase") == {
        8: "CLOSED", 9: "OPEN", 16: "OPEN", 17: "CLOSED",
    }


def test_point_filter_takes_any_text(spark):
    tape = trades(spark, ("X", 1, 1, 1, 1))
    assert rows.of_stock(tape, "' or '1'='1").isEmpty()


def test_places_that_do_not_fit_are_an_error(spark):
    tape = spark.createDataFrame([("a", 0), ("b", (1 << 40) - 1)], "path string, seq bigint")
    assert sorted(r.seq for r in rows.number_files(tape).collect()) == [0, (1 << 41) - 1]
    with pytest.raises(Exception, match="too large"):
        rows.number_files(spark.createDataFrame([("a", 1 << 40)], "path string, seq bigint")).collect()


def test_require_rows(spark):
    with pytest.raises(ValueError, match="no trades"):
        rows.require_rows(spark.range(0), "trades")
