"""The named queries: one callable (spark, sf_dir) -> DataFrame per operator.

The test events are sparse (a few per instrument and day), so bars are one day
and frames one day or more; all widths are parameters of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import display, times
from tickloom.operators import bars, joins, reports, rows, signals
from tickloom.plans import features, model, queries, sql_functions, tape_views
from tickloom.session import materialise, scratch_path
from tickloom.sources import frames as frame_source
from tickloom.sources import messages, sinks, tables, tape_source
from tickloom.streaming import live, partial
from tickloom.schema import (
    BAR_SUMMARY,
    ENRICHED_TRADES,
    LANDED_MESSAGES,
    MESSAGES,
    REJECTED,
    STOCK_SUMMARY,
)

DAY = times.DAY_NS
DAY_S = 86_400
QUARTER_DAY = DAY // 4
PREFIX_BYTES = 100_000
FILE_FRAMES = 5_000

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _landed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(tape_views.frames(spark, sf_dir), "frames")


_MESSAGE_COLUMNS = (
    "seq",
    "msg_type",
    "stock_locate",
    "ts_ns",
    "stock",
    "shares",
    "price_ticks",
    "price",
    "order_ref",
    "side",
    "market_cat",
)


# --- sources and sinks -------------------------------------------------------


@query
def decode_messages(spark, sf_dir):
    return messages.decode_messages(_landed_frames(spark, sf_dir)).select(*_MESSAGE_COLUMNS)


@query
def rejected_frames(spark, sf_dir):
    rejected = messages.rejected_frames(_landed_frames(spark, sf_dir))
    return rejected.select("seq", "reason", F.octet_length("payload").alias("size"))


@query
def frame_split(spark, sf_dir):
    """Binary files of the whole tape, split again into frames and decoded."""
    path = scratch_path(spark, "feed")
    tape_views.write_feed(tape_views.frames(spark, sf_dir), path)
    frames = materialise(frame_source.read_frames(spark, path), "frames")
    return messages.decode_messages(frames).select(*_MESSAGE_COLUMNS[1:])


@query
def frame_split_ranges(spark, sf_dir):
    """The same with every file cut into many byte ranges, as done for long files."""
    path = scratch_path(spark, "feed")
    tape_views.write_feed(tape_views.frames(spark, sf_dir), path)
    frames = frame_source.read_frames(
        spark, path, range_bytes=frame_source.SMALLEST_RANGE
    )
    return messages.decode_messages(materialise(frames, "frames")).select(*_MESSAGE_COLUMNS[1:])


def _written_feed(spark, sf_dir):
    path = scratch_path(spark, "feed")
    tape_views.write_feed(tape_views.frames(spark, sf_dir), path)
    return path


@query
def tape_source_messages(spark, sf_dir):
    """Binary files of the whole tape through the data source, cut into many byte ranges."""
    feed = _written_feed(spark, sf_dir)
    found = tape_source.messages(spark, feed, range_bytes=frame_source.SMALLEST_RANGE)
    return found.select(*_MESSAGE_COLUMNS[1:])


@query
def tape_source_trades(spark, sf_dir):
    """Trades of a few stocks; other frames are told apart by their bytes and never cut out."""
    stocks = [f"S{n}" for n in range(1, 10)]
    found = tape_source.messages(spark, _written_feed(spark, sf_dir), kinds=["P"], stocks=stocks)
    return found.select(*_MESSAGE_COLUMNS[1:])


@query
def prefix_sample(spark, sf_dir):
    """The first bytes of every file of a feed in files of 5,000 frames; no more of them is read."""
    path = scratch_path(spark, "feed")
    feed = tape_views.frames(spark, sf_dir).withColumn(
        "path", F.lpad(times.whole(F.col("seq"), FILE_FRAMES).cast("string"), 12, "0")
    )
    tape_views.write_feed(feed, path, by_path=True)
    kept = materialise(frame_source.read_frames(spark, path, budget=PREFIX_BYTES), "frames")
    return messages.decode_messages(kept).select(F.col("seq").alias("place"), *_MESSAGE_COLUMNS[1:])


@query
def prefix_sample_rows(spark, sf_dir):
    """The same for frames that are a table already."""
    kept = frame_source.prefix_sample(_landed_frames(spark, sf_dir), PREFIX_BYTES, 5_000)
    return kept.select("seq", F.octet_length("payload").alias("size"))


@query
def write_partitioned(spark, sf_dir):
    """Landed messages written in the partitioned layout and read back."""
    path = scratch_path(spark, "messages")
    tape = tape_views.messages(spark, sf_dir).filter("msg_type <> 'X'")
    sinks.write_partitioned(
        tape.withColumn("hour", times.hour_of_day(F.col("ts_ns"))), path
    )
    return tables.scan_parquet(spark, path, LANDED_MESSAGES).select(*_MESSAGE_COLUMNS, "hour")


@query
def landed_columns(spark, sf_dir):
    """Dated messages landed by day, with all columns of the landed table."""
    path = scratch_path(spark, "messages")
    tape = tape_views.dated(spark, sf_dir).filter("msg_type <> 'X'")
    sinks.write_partitioned(rows.landed(tape), path, ("trade_date", "msg_type"))
    return tables.scan_parquet(spark, path, LANDED_MESSAGES).select(
        *_MESSAGE_COLUMNS,
        F.col("trade_date").cast("string").alias("trade_date"),
        "timestamp",
        F.date_format("readable_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("readable_time"),
        "hour",
    )


@query
def row_counts(spark, sf_dir):
    """Rows of each message type of a feed, those that do not occur included."""
    return rows.row_counts(tape_views.messages(spark, sf_dir), "RAPXD")


@query
def scan_parquet(spark, sf_dir):
    """Enriched trades in folders per category; the folder value stays text."""
    path = scratch_path(spark, "enriched")
    enriched = tape_views.enriched(spark, sf_dir).withColumn(
        "hour", times.hour_of_day(F.col("ts_ns"))
    )
    sinks.write_partitioned(enriched, path, ("market_cat", "hour"))
    landed = tables.scan_parquet(spark, path, ENRICHED_TRADES)
    return landed.filter("market_cat = 'Q'").select(
        "seq", "stock", "ts_ns", "shares", "price", "hour", "stock_locate", "market_cat"
    )


@query
def write_signal(spark, sf_dir):
    path = scratch_path(spark, "obi")
    obi = signals.order_book_imbalance(tape_views.adds(spark, sf_dir), DAY)
    sinks.write_signal(obi, path)
    return tables.scan_parquet(spark, path, obi.schema)


@query
def summary_csv(spark, sf_dir):
    """Bar summary written as CSV and read back with its schema."""
    path = scratch_path(spark, "bars")
    sinks.write_summary_csv(tape_views.item_bars(spark, sf_dir), path)
    return tables.scan_summary_csv(spark, path, BAR_SUMMARY)


@query
def stock_summary_csv(spark, sf_dir):
    path = scratch_path(spark, "stocks")
    enriched = tape_views.enriched(spark, sf_dir)
    sinks.write_summary_csv(bars.stock_summary(enriched), path)
    return tables.scan_summary_csv(spark, path, STOCK_SUMMARY)


# --- rows and columns --------------------------------------------------------


@query
def demux(spark, sf_dir):
    """Directory, add-order and trade tables carved out of the wide one."""
    tape = tape_views.messages(spark, sf_dir)
    parts = [
        rows.of_type(tape, kind).select("seq", "msg_type", "stock", "ts_ns") for kind in "RAP"
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query
def in_list(spark, sf_dir):
    tape = tape_views.messages(spark, sf_dir)
    return rows.in_values(tape, "msg_type", ["A", "P"]).select("seq", "msg_type", "price_ticks")


@query
def trade_columns(spark, sf_dir):
    return rows.trade_columns(tape_views.messages(spark, sf_dir, "purchase"))


@query
def point_filter(spark, sf_dir):
    trades = tape_views.trades(spark, sf_dir)
    return rows.of_stock(trades, "S7").select("seq", "stock", "ts_ns", "shares", "price")


@query
def time_columns(spark, sf_dir):
    timed = rows.with_times(tape_views.trades(spark, sf_dir))
    return timed.select(
        "seq",
        F.date_format("readable_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("readable_time"),
        "hour",
        "timestamp_sec",
        "minute_bucket",
        times.minute_start(F.col("timestamp_sec")).alias("minute_start_sec"),
    )


@query
def minute_bucket_rounded(spark, sf_dir):
    timed = rows.with_bucket(tape_views.item_trades(spark, sf_dir), 2 * DAY, "round")
    return timed.groupBy("minute_bucket").agg(F.count(F.lit(1)).alias("trades"))


@query
def named_keys(spark, sf_dir):
    """Stocks with a usable name among all messages."""
    kept = rows.named_keys_only(tape_views.messages(spark, sf_dir))
    return kept.groupBy("stock").agg(F.count(F.lit(1)).alias("messages"))


@query
def complete_rows(spark, sf_dir):
    tape = tape_views.messages(spark, sf_dir)
    return rows.complete_rows(tape, ["order_ref", "side"]).select("seq", "order_ref", "side")


# --- joins -------------------------------------------------------------------


@query
def enrich_trades(spark, sf_dir):
    return tape_views.enriched(spark, sf_dir).select(
        "seq", "stock", "ts_ns", "shares", "price_ticks", "stock_locate", "market_cat"
    )


@query
def enrich_trades_salted(spark, sf_dir):
    """Hot stocks spread by hand: the way where adaptive execution is off."""
    joined = joins.enrich_trades(
        tape_views.trades(spark, sf_dir), tape_views.directory(spark, sf_dir), salts=32
    )
    return joined.select(
        "seq", "stock", "ts_ns", "shares", "price_ticks", "stock_locate", "market_cat"
    )


@query
def enrich_trades_l(spark, sf_dir):
    return joins.enrich_trades(
        tape_views.item_trades(spark, sf_dir), tape_views.item_directory(spark, sf_dir)
    ).select("seq", "stock", "ts_ns", "shares", "price_ticks", "market_cat")


@query
def directory_latest(spark, sf_dir):
    return joins.directory_latest(tape_views.messages(spark, sf_dir, "signup"))


@query
def directory_latest_ties(spark, sf_dir):
    """Directory rows of one time in several files."""
    return joins.directory_latest(tape_views.tied(spark, sf_dir, "signup"))


@query
def asof_ties(spark, sf_dir):
    """Orders and trades of one time in several files."""
    tape = tape_views.tied(spark, sf_dir, "purchase", "view", "click")
    columns = ("seq", "stock_locate", "ts_ns", "price")
    return joins.market_impact(tape, columns, slice_ns=QUARTER_DAY)


@query
def attach_obi(spark, sf_dir):
    trades = rows.with_bucket(tape_views.trades(spark, sf_dir), DAY)
    obi = signals.order_book_imbalance(tape_views.adds(spark, sf_dir), DAY)
    return joins.attach_imbalance(trades, obi).select("seq", "stock", "minute_bucket", "OBI")


@query
def asof_last_quote(spark, sf_dir):
    tape = tape_views.messages(spark, sf_dir, "purchase", "view", "click")
    columns = ("seq", "stock_locate", "ts_ns", "price")
    return joins.market_impact(tape, columns, slice_ns=QUARTER_DAY)


@query
def asof_last_quote_by_side(spark, sf_dir):
    tape = tape_views.messages(spark, sf_dir, "purchase", "view", "click")
    return joins.market_impact(
        tape, ("seq", "side", "price"), slice_ns=QUARTER_DAY, by_side=True
    )


@query
def semi_join_topk(spark, sf_dir):
    trades = tape_views.trades(spark, sf_dir)
    return joins.keep_top(trades, bars.top_by_volume(trades, 10)).select(
        "seq", "stock", "ts_ns", "shares", "price_ticks"
    )


# --- aggregations ------------------------------------------------------------


@query
def directory_distinct(spark, sf_dir):
    return tape_views.directory(spark, sf_dir)


@query
def vwap_by_stock(spark, sf_dir):
    return bars.vwap_by_stock(
        tape_views.item_trades(spark, sf_dir), tape_views.item_directory(spark, sf_dir)
    )


@query
def vwap_by_stock_e(spark, sf_dir):
    return bars.vwap_by_stock(
        tape_views.trades(spark, sf_dir), tape_views.directory(spark, sf_dir)
    )


@query
def minute_bars(spark, sf_dir):
    return bars.minute_bars(
        tape_views.trades(spark, sf_dir), tape_views.directory(spark, sf_dir), bar_ns=DAY
    )


@query
def minute_bars_joined(spark, sf_dir):
    """The same bars from joined rows instead of joined sums."""
    return bars.minute_bars(tape_views.enriched(spark, sf_dir), bar_ns=DAY)


@query
def minute_bars_l(spark, sf_dir):
    return tape_views.item_bars(spark, sf_dir).orderBy("stock", "minute_bucket")


@query
def stock_summary(spark, sf_dir):
    return bars.stock_summary(
        tape_views.item_trades(spark, sf_dir), tape_views.item_directory(spark, sf_dir)
    )


@query
def order_book_imbalance(spark, sf_dir):
    return signals.order_book_imbalance(tape_views.adds(spark, sf_dir), DAY)


@query
def order_book_imbalance_eps(spark, sf_dir):
    return signals.order_book_imbalance_eps(tape_views.adds(spark, sf_dir), DAY_S)


@query
def ohlc_candles(spark, sf_dir):
    return bars.ohlc_candles(tape_views.trades(spark, sf_dir), DAY)


@query
def ohlc_candles_ties(spark, sf_dir):
    """Open and close among trades of one time in several files."""
    return bars.ohlc_candles(rows.trades(tape_views.tied(spark, sf_dir, "purchase")), DAY)


@query
def minute_bars_two_days(spark, sf_dir):
    """Hourly bars of a tape of many days whose times count from midnight."""
    tape = rows.trades(tape_views.dated(spark, sf_dir, "purchase"))
    table = bars.minute_bars(tape.withColumn("market_cat", F.lit("Q")), bar_ns=times.HOUR_NS)
    return table.withColumn("trade_date", F.col("trade_date").cast("string"))


@query
def ohlc_candles_rounded(spark, sf_dir):
    return bars.ohlc_candles(tape_views.trades(spark, sf_dir), DAY, "round")


@query
def top_k_by_volume(spark, sf_dir):
    return bars.top_by_volume(tape_views.trades(spark, sf_dir), 10)


@query
def legacy_summary(spark, sf_dir):
    """Line items as a legacy table: shares, price and time, nothing else."""
    trades = tape_views.item_trades(spark, sf_dir)
    legacy = tables.normalise_legacy(
        trades.select("stock", "shares", F.col("price_ticks").alias("price"))
    )
    return bars.legacy_stock_summary(legacy)


@query
def legacy_row_index(spark, sf_dir):
    """Events in order of time as a legacy table: the bar is the row number."""
    trades = tape_views.trades(spark, sf_dir)
    legacy = tables.normalise_legacy(
        trades.select("stock", "seq", F.col("ts_ns").alias("time"), "shares", "price"),
        ("time", "seq"),
    )
    return legacy.select("seq", "minute_bucket", "volume", "market_cat")


@query
def tickers(spark, sf_dir):
    return bars.tickers(tape_views.trades(spark, sf_dir))


@query
def stock_totals(spark, sf_dir):
    return bars.stock_totals(tape_views.item_bars(spark, sf_dir))


# --- windows -----------------------------------------------------------------


@query
def rolling_volatility(spark, sf_dir):
    spread = signals.rolling_volatility(
        tape_views.trades(spark, sf_dir), DAY
    )
    return _rounded(spread.select("seq", "stock", "ts_ns", "price", "volatility"), "volatility")


@query
def rolling_volatility_l(spark, sf_dir):
    """All stocks of the line-item tape, many trades of one time."""
    spread = signals.rolling_volatility(
        tape_views.item_trades(spark, sf_dir), 90 * DAY, top=None
    )
    return _rounded(
        spread.select("stock", "ts_ns", "shares", "price_ticks", "volatility"), "volatility"
    )


@query
def rolling_volatility_60s(spark, sf_dir):
    stats = signals.rolling_trade_stats(tape_views.trades(spark, sf_dir), DAY_S, DAY_S)
    return _rounded(
        stats.select("seq", "stock", "timestamp_sec", "Rolling_Volatility"), "Rolling_Volatility"
    )


@query
def rolling_count_vwap(spark, sf_dir):
    stats = signals.rolling_trade_stats(tape_views.trades(spark, sf_dir), DAY_S, DAY_S)
    return stats.select("seq", "stock", "timestamp_sec", "Trade_Count_Per_Min", "VWAP")


@query
def vwap_change(spark, sf_dir):
    stats = signals.rolling_trade_stats(tape_views.trades(spark, sf_dir), DAY_S, DAY_S)
    return stats.select("seq", "VWAP", "VWAP_prev", "VWAP_Change")


@query
def vwap_change_ties(spark, sf_dir):
    """First trade of a second among trades of one time in several files."""
    tape = rows.trades(tape_views.tied(spark, sf_dir, "purchase"))
    stats = signals.rolling_trade_stats(tape, DAY_S, DAY_S)
    return stats.select("seq", "VWAP", "VWAP_prev", "VWAP_Change")


@query
def rolling_two_days(spark, sf_dir):
    """Windows over a tape of many days whose times count from midnight."""
    tape = rows.trades(tape_views.dated(spark, sf_dir, "purchase"))
    spread = signals.rolling_volatility(tape, QUARTER_DAY, top=None, slice_ns=times.HOUR_NS)
    day = F.col("trade_date").cast("string").alias("trade_date")
    return _rounded(spread.select("seq", day, "stock", "ts_ns", "volatility"), "volatility")


@query
def future_max_label(spark, sf_dir):
    stats = signals.rolling_trade_stats(tape_views.trades(spark, sf_dir), DAY_S, DAY_S)
    return stats.select("seq", "price", "Future_Max_Price", "price_direction")


@query
def bar_pct_change(spark, sf_dir):
    changes = reports.bar_pct_change(tape_views.day_bars(spark, sf_dir))
    return changes.select("stock", "minute_bucket", "avg_price", "pct_change")


@query
def tick_direction(spark, sf_dir):
    marked = reports.tick_direction(tape_views.day_bars(spark, sf_dir))
    return marked.select("stock", "minute_bucket", "avg_price", "direction")


@query
def session_change(spark, sf_dir):
    return reports.session_change(tape_views.day_bars(spark, sf_dir))


@query
def last_n_bars(spark, sf_dir):
    newest = reports.last_n_bars(tape_views.item_bars(spark, sf_dir), 60)
    return newest.select("stock", "minute_bucket", "volume", "idx")


@query
def latest_row(spark, sf_dir):
    obi = signals.order_book_imbalance(tape_views.adds(spark, sf_dir), DAY)
    return reports.latest_row(obi, "OBI")


# --- reports -----------------------------------------------------------------


@query
def bar_return_volatility(spark, sf_dir):
    spread = reports.bar_return_volatility(tape_views.day_bars(spark, sf_dir))
    return _rounded(spread, "volatility")


@query
def abnormal_volume(spark, sf_dir):
    return reports.abnormal_volume(tape_views.day_bars(spark, sf_dir))


@query
def abnormal_last_bar(spark, sf_dir):
    return reports.abnormal_volume(tape_views.day_bars(spark, sf_dir), "last_bar")


@query
def session_phase(spark, sf_dir):
    return reports.session_phase(tape_views.trades(spark, sf_dir))


@query
def key_metrics(spark, sf_dir):
    return reports.key_metrics(tape_views.day_bars(spark, sf_dir))


@query
def session_change_ties(spark, sf_dir):
    """Brands with many categories in one bar: the first and last by the whole category."""
    return reports.session_change(tape_views.brand_bars(spark, sf_dir))


@query
def key_metrics_ties(spark, sf_dir):
    return reports.key_metrics(tape_views.brand_bars(spark, sf_dir))


@query
def key_metric_labels(spark, sf_dir):
    """Display strings of the key metrics."""
    return reports.key_metric_labels(reports.key_metrics(tape_views.day_bars(spark, sf_dir)))


@query
def volume_profile(spark, sf_dir):
    return reports.volume_profile(tape_views.item_bars(spark, sf_dir))


@query
def top_liquidity(spark, sf_dir):
    return reports.top_liquidity(
        bars.stock_summary(
            tape_views.item_trades(spark, sf_dir), tape_views.item_directory(spark, sf_dir)
        )
    )


@query
def trade_tape(spark, sf_dir):
    return reports.trade_tape(tape_views.day_bars(spark, sf_dir)).drop("market_cat")


@query
def trade_tape_full(spark, sf_dir):
    tape = reports.trade_tape(tape_views.day_bars(spark, sf_dir), scope="full")
    return tape.select("stock", "minute_bucket", "idx", "direction")


@query
def depth_ladder(spark, sf_dir):
    return reports.depth_ladder(tape_views.adds(spark, sf_dir), 5)


@query
def depth_ladder_by_bar(spark, sf_dir):
    """The ladder at the end of each day with orders."""
    return reports.depth_ladder_by_bar(tape_views.adds(spark, sf_dir), 5, DAY)


@query
def chart_candles(spark, sf_dir):
    candles = bars.ohlc_candles(tape_views.trades(spark, sf_dir), DAY)
    return reports.chart_candles(candles, DAY_S)


@query
def chart_vwap(spark, sf_dir):
    candles = bars.ohlc_candles(tape_views.trades(spark, sf_dir), DAY)
    return reports.chart_vwap(candles, DAY_S)


@query
def obi_histogram(spark, sf_dir):
    obi = signals.order_book_imbalance(tape_views.adds(spark, sf_dir), DAY)
    return reports.obi_histogram(obi, DAY_S)


@query
def upper_ticker(spark, sf_dir):
    stocks = bars.tickers(tape_views.trades(spark, sf_dir))
    lower = stocks.select(F.lower("stock").alias("stock"))
    return lower.withColumn("ticker", display.upper_ticker(F.col("stock")))


@query
def signed_obi(spark, sf_dir):
    obi = signals.order_book_imbalance(tape_views.adds(spark, sf_dir), DAY)
    return obi.select("stock", "minute_bucket", display.signed(F.col("OBI")).alias("label"))


# --- streams -----------------------------------------------------------------


def _feed_runs(spark, sf_dir, path, decode):
    """The tape's feed in two arrivals: files of even number, then the others. Yields after each landing."""
    feed = scratch_path(spark, "feed")
    part = times.whole(F.col("seq"), FILE_FRAMES)
    tape = tape_views.frames(spark, sf_dir).withColumn("path", F.lpad(part.cast("string"), 12, "0"))
    checkpoint = scratch_path(spark, "checkpoint")
    for turn in range(2):
        tape_views.write_feed(tape.where(part % 2 == turn), f"{feed}/{turn}", by_path=True)
        yield live.land_feed(spark, feed, path, checkpoint, decode)


def _streamed(spark, sf_dir, kind):
    """Bars of a feed that lands in two runs, kept up to date and folded; and where it landed."""
    source, path = scratch_path(spark, "landed"), scratch_path(spark, "sums")
    for _ in _feed_runs(spark, sf_dir, source, messages.decode_messages):
        live.update_sums(spark, kind, source, MESSAGES, path, times.HOUR_NS)
    live.compact(spark, kind, path)
    return live.summed(spark, kind, path), source


@query
def stream_land(spark, sf_dir):
    """Feed files of the whole tape landed by a stream in two runs."""
    path = scratch_path(spark, "landed")
    list(_feed_runs(spark, sf_dir, path, messages.decode_messages))
    return live.landed(spark, path, MESSAGES).select(*_MESSAGE_COLUMNS[1:])


@query
def stream_rejected(spark, sf_dir):
    """Frames that a landing stream refuses, counted by reason."""
    path = scratch_path(spark, "refused")
    list(_feed_runs(spark, sf_dir, path, messages.rejected_frames))
    refused = live.landed(spark, path, REJECTED)
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("frames"))


@query
def stream_minute_bars(spark, sf_dir):
    sums, source = _streamed(spark, sf_dir, partial.BARS)
    return partial.BARS.finish(sums, rows.directory(live.landed(spark, source, MESSAGES)))


@query
def stream_order_book_imbalance(spark, sf_dir):
    return partial.IMBALANCE.finish(_streamed(spark, sf_dir, partial.IMBALANCE)[0])


@query
def stream_candles(spark, sf_dir):
    return partial.CANDLES.finish(_streamed(spark, sf_dir, partial.CANDLES)[0])


# --- read queries ------------------------------------------------------------


@query
def q_tickers(spark, sf_dir):
    return queries.q_tickers(tape_views.item_trades(spark, sf_dir))


@query
def q_summary(spark, sf_dir):
    return queries.q_summary(tape_views.enriched(spark, sf_dir))


@query
def q_candles(spark, sf_dir):
    """One stock over joined rows; several categories repeat its trades."""
    return queries.q_candles(tape_views.enriched(spark, sf_dir), "S7", DAY)


@query
def obi_series(spark, sf_dir):
    obi = signals.order_book_imbalance(tape_views.adds(spark, sf_dir), DAY)
    return queries.q_obi_series(obi, "S7")


@query
def sentiment(spark, sf_dir):
    """All stocks with any message; some have no add order."""
    obi = signals.order_book_imbalance(tape_views.adds(spark, sf_dir), DAY)
    return queries.q_sentiment(tape_views.messages(spark, sf_dir), obi)


def _functions(spark, sf_dir, call, **args):
    """A call of one of the SQL table functions over the message tape."""
    obi = signals.order_book_imbalance(tape_views.adds(spark, sf_dir), DAY)
    tape = tape_views.messages(spark, sf_dir)
    sql_functions.register(tape, tape_views.enriched(spark, sf_dir), obi, DAY)
    return spark.sql(f"select * from {call}", args=args)


@query
def sql_tickers(spark, sf_dir):
    return _functions(spark, sf_dir, "q_tickers()")


@query
def sql_summary(spark, sf_dir):
    return _functions(spark, sf_dir, "q_summary()")


@query
def sql_candles(spark, sf_dir):
    return _functions(spark, sf_dir, "q_candles(stock => :stock)", stock="S7")


@query
def sql_obi_series(spark, sf_dir):
    return _functions(spark, sf_dir, "q_obi_series(stock => :stock)", stock="S7")


@query
def sql_sentiment(spark, sf_dir):
    """All stocks, as no argument is given."""
    return _functions(spark, sf_dir, "q_sentiment()")


# --- model -------------------------------------------------------------------


def _test_features(spark, sf_dir, **options):
    tape = tape_views.messages(spark, sf_dir, "purchase", "view", "click")
    return features.build_features(
        tape, bar_s=DAY_S, window_s=DAY_S, horizon_s=DAY_S, **options
    )


@query
def build_features(spark, sf_dir):
    return _rounded(_test_features(spark, sf_dir, top=50), "Rolling_Volatility")


@query
def build_features_lagged(spark, sf_dir):
    """The imbalance of the bar before, free of look-ahead."""
    return _rounded(_test_features(spark, sf_dir, top=50, obi_lag=1), "Rolling_Volatility")


@query
def chrono_split(spark, sf_dir):
    """Feature rows with their part of an exact 80/20 split in time."""
    table = materialise(_test_features(spark, sf_dir, top=50), "features")
    train, test = model.chrono_split(model.assemble(table))
    keep = ["stock", "timestamp_sec"]
    return train.select(*keep, F.lit("train").alias("part")).union(
        test.select(*keep, F.lit("test").alias("part"))
    )


@query
def assembled(spark, sf_dir):
    """The elements of the assembled vector, row by row."""
    rows_ = model.assemble(tape_views.margin_features(spark, sf_dir))
    parts = rows_.select("stock", "timestamp_sec", vector_to_array("features").alias("v"))
    names = [F.col("v")[i].alias(name) for i, name in enumerate(features.FEATURES)]
    return parts.select("stock", "timestamp_sec", *names)


@query
def train_score(spark, sf_dir):
    """Confusion table and metrics on the later rows, for a label the model can learn fully."""
    outcome = model.fit_and_evaluate(tape_views.margin_features(spark, sf_dir))
    metrics = {name: F.lit(value) for name, value in outcome.metrics.items()}
    return outcome.confusion.withColumns(metrics)
