"""Properties that matter on a cluster: skew, order, partitions, pruning."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import times
from tickloom.operators import bars, joins, reports, signals
from tickloom.operators.slices import last_known, rolling_sums
from tickloom.plans import features, tape_views

DAY = times.DAY_NS


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def _hot(spark, n=30_000):
    """One key holds a third of all rows."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 977).cast("string"))
    )
    return spark.range(n).select(
        key.alias("k"), F.col("id").alias("t"), F.col("id").alias("i"), (F.col("id") % 7).alias("v")
    )


def _largest_share(df):
    # Using all columns keeps the optimizer from dropping the window under test.
    per_task = df.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(*df.columns))
    )
    sizes = [r.n for r in per_task.collect()]
    return max(sizes) / sum(sizes)


def test_hot_key_is_spread(spark, many_partitions):
    table = _hot(spark)
    assert _largest_share(table.repartition("k")) > 0.33
    sums = rolling_sums(table, ["k"], "t", 100, {"s": F.col("v")}, 200)
    assert _largest_share(sums) < 0.12
    known = last_known(table, ["k"], "t", "i", F.when(F.col("v") == 0, F.col("v")), 200, "last")
    assert _largest_share(known) < 0.12


def test_salted_join_spreads_a_hot_stock(spark, many_partitions):
    facts = _hot(spark).withColumnRenamed("k", "stock")
    directory = facts.select("stock").distinct().withColumn("market_cat", F.lit("Q"))
    joined = joins.enrich_trades(facts, directory.hint("merge"), salts=32)
    assert "SortMergeJoin" in _plan(joined)
    assert joined.count() == facts.count()
    assert _largest_share(joined) < 0.12


@pytest.mark.parametrize("view", [tape_views.messages, tape_views.tied])
def test_order_and_partitions_do_not_matter(spark, sf_dir, view):
    tape = view(spark, sf_dir)
    shuffled = tape.orderBy(F.rand(5)).repartition(7)

    def results(messages):
        trades = messages.filter("msg_type = 'P'")
        adds = messages.filter("msg_type = 'A'")
        day_bars = bars.minute_bars(trades.withColumn("market_cat", F.lit("Q")), bar_ns=DAY)
        return {
            "bars": day_bars,
            "candles": bars.ohlc_candles(trades, DAY),
            "obi": signals.order_book_imbalance(adds, DAY),
            "impact": joins.market_impact(messages, ("seq", "price"), slice_ns=DAY // 3),
            "volatility": signals.rolling_volatility(trades, 3 * DAY, slice_ns=DAY).select(
                "seq", "volatility"
            ),
            "features": features.build_features(
                messages, top=20, bar_s=86_400, window_s=86_400, horizon_s=86_400
            ),
            "ladder": reports.depth_ladder(adds),
            "tape": reports.trade_tape(day_bars),
        }

    first, second = results(tape), results(shuffled)
    for name in first:
        left = sorted(map(repr, first[name].collect()))
        assert left == sorted(map(repr, second[name].collect())), name


def test_bars_add_up(spark, sf_dir):
    trades = tape_views.item_trades(spark, sf_dir)
    table = bars.minute_bars(
        trades, tape_views.item_directory(spark, sf_dir), bar_ns=30 * DAY, ordered=False
    )
    totals = bars.stock_totals(table).select("stock", "total_volume", "trade_count")
    summary = bars.stock_summary(trades, tape_views.item_directory(spark, sf_dir)).select(
        "stock", "total_volume", "trade_count"
    )
    assert totals.exceptAll(summary).isEmpty() and summary.exceptAll(totals).isEmpty()
    bad = bars.ohlc_candles(trades, 30 * DAY).filter(
        "low > open or low > close or high < open or high < close"
        " or vwap < low - 1e-9 or vwap > high + 1e-9"
    )
    assert bad.isEmpty()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = _plan(bars.top_by_volume(tape_views.trades(spark, sf_dir)))
    assert "EqualTo(event_type,purchase)" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in plan


def test_ranked_reports_cut_before_the_shuffle(spark, sf_dir):
    ladder = _plan(reports.depth_ladder(tape_views.adds(spark, sf_dir)))
    newest = _plan(reports.last_n_bars(tape_views.day_bars(spark, sf_dir)))
    for plan in (ladder, newest):
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_aggregations_hash_and_combine(spark, sf_dir):
    trades = tape_views.trades(spark, sf_dir)
    day_bars = tape_views.day_bars(spark, sf_dir)
    for df in (
        bars.ohlc_candles(trades),
        signals.second_stats(trades),
        reports.session_change(day_bars),
        reports.key_metrics(day_bars),
        reports.abnormal_volume(day_bars, "last_bar"),
        joins.directory_latest(tape_views.messages(spark, sf_dir)),
    ):
        plan = _plan(df)
        assert "SortAggregate" not in plan and "partial_" in plan


def _scans(df) -> int:
    return _plan(df).count("FileScan")


def test_inputs_are_scanned_no_more_than_needed(spark, sf_dir):
    trades = tape_views.trades(spark, sf_dir)
    assert _scans(signals.rolling_volatility(trades)) <= 2
    assert _scans(signals.rolling_volatility(trades, top=None)) == 1
    assert _scans(features.build_features(tape_views.messages(spark, sf_dir))) <= 3
    assert _scans(reports.abnormal_volume(tape_views.day_bars(spark, sf_dir), "last_bar")) == 1


def test_joins_start_no_job_and_copy_no_dimension(spark, sf_dir):
    trades, items = tape_views.item_trades(spark, sf_dir), tape_views.item_directory(spark, sf_dir)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    built = [bars.vwap_by_stock(trades, items), bars.stock_summary(trades, items), joins.enrich_trades(trades, items)]
    assert len(tracker.getJobIdsForGroup()) == before
    assert all("explode" not in _plan(df) for df in built)


def test_top_join_is_broadcast_only_when_small(spark, sf_dir):
    trades = tape_views.trades(spark, sf_dir)
    assert "BroadcastHashJoin" in _plan(joins.keep_top(trades, bars.top_by_volume(trades, 10)))
    assert "SortMergeJoin" in _plan(joins.keep_top(trades, bars.top_by_volume(trades, 10**8)))
