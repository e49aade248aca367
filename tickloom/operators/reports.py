"""Report tables per stock, for all stocks in one job.

Input is the bar table (stock, minute_bucket, market_cat, volume, vwap,
avg_price, trade_count), whose size per stock is bounded by the number of bars,
or trades and add orders where stated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import display, measures, times
from tickloom.functions.times import by_day
from tickloom.operators import rows
from tickloom.session import ship_package

# Thresholds of the reports.
HIGH_VOLATILITY = 0.02
ELEVATED_VOLATILITY = 0.01
OPEN_HOURS = (9, 16)
BULLISH_ABOVE = 65.0
BEARISH_BELOW = 35.0

_BAR_ORDER = ("minute_bucket", "market_cat")


def _bar_window(bars: DataFrame):
    return Window.partitionBy(*by_day(bars, "stock")).orderBy(*_BAR_ORDER)


def bar_pct_change(bars: DataFrame) -> DataFrame:
    """Add the change of avg_price from the stock's bar before, as a fraction."""
    last = F.lag("avg_price").over(_bar_window(bars))
    return bars.withColumn("pct_change", measures.ratio(F.col("avg_price"), last) - F.lit(1.0))


def bar_return_volatility(bars: DataFrame) -> DataFrame:
    """Sample stddev of `pct_change` per stock (0.0 for one bar) and its regime.

    Two bars give one change and so no stddev; a change from a price of zero has
    no size. The volatility is then NULL and the regime NORMAL.
    """
    last = F.lag("avg_price").over(_bar_window(bars))
    from_zero = F.coalesce((last == 0) & (F.col("avg_price") != 0), F.lit(False))
    spread = F.when(F.col("n") <= 1, F.lit(0.0)).when(~F.col("undefined"), F.col("sd"))
    return (
        bar_pct_change(bars)
        .withColumn("from_zero", from_zero)
        .groupBy(*by_day(bars, "stock"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.stddev_samp("pct_change").alias("sd"),
            F.bool_or("from_zero").alias("undefined"),
        )
        .select(*by_day(bars, "stock"), spread.alias("volatility"))
        .withColumn("regime", volatility_regime(F.col("volatility")))
    )


def volatility_regime(volatility: Column) -> Column:
    return (
        F.when(volatility > HIGH_VOLATILITY, "HIGH")
        .when(volatility > ELEVATED_VOLATILITY, "ELEVATED")
        .otherwise("NORMAL")
    )


def abnormal_volume(bars: DataFrame, rule: str = "total") -> DataFrame:
    """Flag stocks whose volume is above twice their mean bar volume.

    `total` compares the sum over all bars, `last_bar` the newest bar.
    """
    if rule == "total":
        current = F.col("total_volume")
    elif rule == "last_bar":
        current = F.col("last_bar_volume")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    per_bar = bars.groupBy(*by_day(bars, "stock", "minute_bucket")).agg(
        F.sum("volume").alias("v"), F.count("volume").alias("n")
    )
    joined = per_bar.groupBy(*by_day(bars, "stock")).agg(
        F.sum("v").alias("total_volume"),
        measures.ratio(F.sum("v"), F.sum("n")).alias("avg_bar_volume"),
        F.max_by("v", "minute_bucket").alias("last_bar_volume"),
    )
    joined = joined.drop("last_bar_volume") if rule == "total" else joined
    return joined.withColumn("abnormal", current > F.lit(2.0) * F.col("avg_bar_volume"))


def session_phase(trades: DataFrame) -> DataFrame:
    """Trades and volume of each (stock, hour of the tape) with its session phase."""
    first, last = OPEN_HOURS
    phase = F.when(F.col("hour").between(first, last), "OPEN").otherwise("CLOSED")
    return (
        trades.withColumn("hour", times.hour_of_day(F.col("ts_ns")))
        .groupBy(*by_day(trades, "stock", "hour"))
        .agg(F.count(F.lit(1)).alias("trade_count"), F.sum("shares").alias("volume"))
        .withColumn("phase", phase)
    )


def _session(bars: DataFrame) -> DataFrame:
    """First and last bar, change and sums of each stock.

    Bars of one time are ordered by their whole category. Those of one (stock,
    time) are as many as it has categories; they are put in order first, and
    numbers alone decide after that.
    """
    change = F.col("last_price") - F.col("first_price")
    percent = F.coalesce(measures.ratio(change, F.col("first_price")) * 100.0, F.lit(0.0))
    of_time = F.sort_array(F.collect_list(F.struct("market_cat", "avg_price", "vwap")))
    per_time = bars.groupBy(*by_day(bars, "stock", "minute_bucket")).agg(
        of_time.alias("__bars"), F.sum("volume").alias("__volume"), F.sum("trade_count").alias("__trades")
    )
    first, last = F.element_at("__bars", 1), F.element_at("__bars", -1)
    return (
        per_time.select(
            *by_day(bars, "stock", "minute_bucket"),
            first["avg_price"].alias("__first"),
            last["avg_price"].alias("__last"),
            last["vwap"].alias("__vwap"),
            "__volume",
            "__trades",
        )
        .groupBy(*by_day(bars, "stock"))
        .agg(
            F.min_by("__first", "minute_bucket").alias("first_price"),
            F.max_by("__last", "minute_bucket").alias("last_price"),
            F.max_by("__vwap", "minute_bucket").alias("last_vwap"),
            F.sum("__volume").alias("total_volume"),
            F.sum("__trades").alias("trade_count"),
        )
        .withColumns({"price_change": change, "price_change_pct": percent})
    )


def session_change(bars: DataFrame) -> DataFrame:
    """First and last price of each stock, their difference, in percent, direction."""
    changed = _session(bars).drop("last_vwap", "total_volume", "trade_count")
    return changed.withColumn("direction", display.trend(F.col("price_change_pct")))


def key_metrics(bars: DataFrame) -> DataFrame:
    """Last price, session change, volume, last VWAP and trade count per stock."""
    return _session(bars).drop("first_price")


def key_metric_labels(metrics: DataFrame) -> DataFrame:
    """`key_metrics` as shown: currency, separators, arrow and percentage."""
    pct = F.col("price_change_pct")
    return metrics.select(
        *by_day(metrics, "stock"),
        display.upper_ticker(F.col("stock")).alias("ticker"),
        display.dollars(F.col("last_price")).alias("last_price"),
        F.concat_ws(" ", display.trend(pct), display.percent(F.abs(pct))).alias("change"),
        display.grouped(F.col("total_volume")).alias("total_volume"),
        display.dollars(F.col("last_vwap")).alias("vwap"),
        display.grouped(F.col("trade_count")).alias("trade_count"),
    )


def volume_profile(bars: DataFrame) -> DataFrame:
    """Volume per bar of each stock."""
    return bars.select(*by_day(bars, "stock", "minute_bucket", "market_cat"), "volume")


def top_liquidity(summary: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of the stock summary with the largest volume, with a label in millions."""
    return (
        summary.orderBy(F.desc("total_volume"), "stock", "market_cat")
        .limit(k)
        .withColumn("label", display.millions(F.col("total_volume")))
    )


def last_n_bars(bars: DataFrame, n: int = 10) -> DataFrame:
    """The newest n bars of each stock, numbered from 0 (oldest kept bar) upwards.

    `row_number() <= n` is cut down on the map side before the shuffle.
    """
    newest_first = Window.partitionBy(*by_day(bars, "stock")).orderBy(*[F.desc(c) for c in _BAR_ORDER])
    kept = bars.withColumn("__rn", F.row_number().over(newest_first)).filter(
        F.col("__rn") <= n
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(*by_day(bars, "stock")))
    return kept.withColumn("idx", (size - F.col("__rn")).cast("bigint")).drop("__rn")


def tick_direction(bars: DataFrame) -> DataFrame:
    """Add the arrow of avg_price against the stock's bar before."""
    change = F.col("avg_price") - F.lag("avg_price").over(_bar_window(bars))
    return bars.withColumn("direction", display.arrow(change))


def trade_tape(bars: DataFrame, n: int = 10, scope: str = "tail") -> DataFrame:
    """The newest n bars of each stock with direction and display strings.

    `tail` compares inside the shown rows, so the oldest one is flat; `full`
    compares with the whole history.
    """
    if scope == "tail":
        shown = tick_direction(last_n_bars(bars, n))
    elif scope == "full":
        shown = last_n_bars(tick_direction(bars), n)
    else:
        raise ValueError(f"unknown scope {scope!r}")
    return shown.withColumns(
        {
            "price_display": display.dollars(F.col("avg_price"), 4),
            "volume_display": display.grouped(F.col("volume")),
            "vwap_display": display.dollars(F.col("vwap"), 4),
        }
    )


def depth_ladder(adds: DataFrame, levels: int = 5) -> DataFrame:
    """Added volume at the best price levels of each side: bids downwards, asks upwards."""
    rank = F.row_number().over(Window.partitionBy(*by_day(adds, "stock", "side")).orderBy(_best_first()))
    return (
        adds.filter(F.col("side").isin("B", "S"))
        .groupBy(*by_day(adds, "stock", "side", "price_ticks"))
        .agg(F.sum("shares").alias("size"))
        .withColumn("level", rank)
        .filter(F.col("level") <= levels)
        .select(
            *by_day(adds, "stock", "side"),
            F.col("level").cast("bigint").alias("level"),
            measures.price(F.col("price_ticks")).alias("price"),
            "size",
        )
    )


def _best_first() -> Column:
    return F.when(F.col("side") == "B", -F.col("price_ticks")).otherwise(F.col("price_ticks"))


def _ladder_scan(keys: Sequence[str], levels: int):
    """Walks over best levels of bars in order, and gives the best levels so far after each bar.

    Orders are only added, so a level that has fallen out of the best never comes
    back: the best levels are all there is to remember.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bar, book = None, None, {}
        found: dict[str, list] = {n: [] for n in (*keys, "minute_bucket", "level", "price_ticks", "size")}

        def close_bar():
            best = sorted(book, reverse=held[keys.index("side")] == "B")[:levels]
            for gone in set(book) - set(best):
                del book[gone]
            for level, ticks in enumerate(best, 1):
                for name, value in zip(found, (*held, bar, level, ticks, book[ticks]), strict=True):
                    found[name].append(value)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (*keys, "minute_bucket", "price_ticks", "size")]
            for *key, at, ticks, size in zip(*columns, strict=True):
                if held is not None and (key != held or at != bar):
                    close_bar()
                if key != held:
                    book.clear()
                held, bar = key, at
                book[ticks] = book.get(ticks, 0) + size
            yield pa.RecordBatch.from_pydict(found, schema=_ladder_schema(batch.schema, keys))
            for values in found.values():
                values.clear()
        if held is not None:
            close_bar()
            yield pa.RecordBatch.from_pydict(found, schema=_ladder_schema(batch.schema, keys))

    return run


def _ladder_schema(given: pa.Schema, keys: Sequence[str]) -> pa.Schema:
    numbers = [(n, pa.int64()) for n in ("minute_bucket", "level", "price_ticks", "size")]
    return pa.schema([*[given.field(k) for k in keys], *map(lambda c: pa.field(*c), numbers)])


def depth_ladder_by_bar(adds: DataFrame, levels: int = 5, bar_ns: int = times.MINUTE_NS) -> DataFrame:
    """The ladder as it stands at the end of each bar in which its side got orders.

    The ladder at another time is that of the newest such bar before it. Orders
    are summed per (bar, price) and cut to the best levels of each bar first, so
    what is walked over in order has a fixed number of rows per bar, however many
    orders a stock has.
    """
    ship_package(adds.sparkSession)
    bucketed = rows.with_bucket(adds.filter(F.col("side").isin("B", "S")), bar_ns)
    keys = by_day(adds, "stock", "side")
    rank = F.row_number().over(Window.partitionBy(*keys, "minute_bucket").orderBy(_best_first()))
    best = (
        bucketed.groupBy(*keys, "minute_bucket", "price_ticks")
        .agg(F.sum("shares").alias("size"))
        .withColumn("level", rank)
        .filter(F.col("level") <= levels)
        .drop("level")
    )
    dated = "trade_date date, " if "trade_date" in keys else ""
    ordered = best.repartition(*keys).sortWithinPartitions(*keys, "minute_bucket")
    walked = ordered.mapInArrow(
        _ladder_scan(keys, levels),
        dated + "stock string, side string, minute_bucket bigint, level bigint, price_ticks bigint, size bigint",
    )
    price = measures.price(F.col("price_ticks")).alias("price")
    return walked.select(*keys, "minute_bucket", "level", price, "size")


def chart_candles(candles: DataFrame, bar_seconds: int = 60) -> DataFrame:
    """Candles with the chart's time axis in seconds."""
    return candles.select(
        *by_day(candles, "stock"),
        times.chart_time(F.col("minute_bucket"), bar_seconds).alias("time"),
        "open",
        "high",
        "low",
        "close",
    )


def chart_vwap(candles: DataFrame, bar_seconds: int = 60) -> DataFrame:
    """The VWAP line over the candles."""
    return candles.select(
        *by_day(candles, "stock"),
        times.chart_time(F.col("minute_bucket"), bar_seconds).alias("time"),
        F.col("vwap").alias("value"),
    )


def obi_histogram(imbalance: DataFrame, bar_seconds: int = 60) -> DataFrame:
    """Bar height |OBI| with its sign and colour; an undefined OBI is not positive."""
    positive = F.coalesce(F.col("OBI") >= 0, F.lit(False))
    return imbalance.select(
        *by_day(imbalance, "stock"),
        times.chart_time(F.col("minute_bucket"), bar_seconds).alias("time"),
        F.abs("OBI").alias("value"),
        F.when(positive, F.lit(1)).otherwise(F.lit(-1)).alias("bar_sign"),
        F.when(positive, F.lit(display.POSITIVE_COLOUR))
        .otherwise(F.lit(display.NEGATIVE_COLOUR))
        .alias("color"),
    )


def latest_row(df: DataFrame, value: str, at: str = "minute_bucket") -> DataFrame:
    """The newest `value` of each stock."""
    return df.groupBy(*by_day(df, "stock")).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def sentiment(stocks: DataFrame, imbalance: DataFrame) -> DataFrame:
    """Score and status of each stock from its newest imbalance.

    A stock without any imbalance row counts as balanced, as does one whose
    newest imbalance is undefined.
    """
    keys = by_day(imbalance, "stock") if "trade_date" in stocks.columns else ["stock"]
    newest = latest_row(imbalance, "OBI").select(*keys, "OBI")
    score = measures.clamp(50.0 + F.col("obi") * 50.0, 0.0, 100.0)
    return (
        stocks.select(*keys)
        .distinct()
        .join(newest, keys, "left")
        .select(*keys, F.coalesce("OBI", F.lit(0.0)).alias("obi"))
        .withColumn("sentiment_score", score)
        .withColumn("status", sentiment_status(F.col("sentiment_score")))
    )


def sentiment_status(score: Column) -> Column:
    return (
        F.when(score > BULLISH_ABOVE, "BULLISH")
        .when(score < BEARISH_BELOW, "BEARISH")
        .otherwise("NEUTRAL")
    )
