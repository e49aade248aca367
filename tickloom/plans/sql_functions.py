"""The read queries as SQL table functions with named arguments.

    spark.sql("select * from q_candles(stock => :stock)", args={"stock": "AAPL"})

A stock's name is an argument and never part of a query text. The functions are
views underneath, so Catalyst sees through them: the stock reaches the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions.times import MINUTE_NS
from tickloom.plans import jobs, queries

# Names of the functions, and which take a stock.
TICKERS, SUMMARY, CANDLES = "q_tickers", "q_summary", "q_candles"
OBI_SERIES, SENTIMENT = "q_obi_series", "q_sentiment"
OF_STOCK = (CANDLES, OBI_SERIES, SENTIMENT)


def _table_function(spark: SparkSession, name: str, table: DataFrame) -> None:
    view = f"{name}_rows"
    table.createOrReplaceTempView(view)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    # Without a stock: all of them. The argument is named with its function, the column is not.
    argument, chosen = (
        ("stock string default null", f" where {name}.stock is null or {view}.stock = {name}.stock")
        if name in OF_STOCK
        else ("", "")
    )
    spark.sql(
        f"create or replace temporary function {name}({argument}) returns table({columns}) "
        f"return select * from {view}{chosen}"
    )


def register(
    trades: DataFrame, enriched: DataFrame, imbalance: DataFrame, bar_ns: int = MINUTE_NS, mode: str = "floor"
) -> None:
    """Make the five read queries table functions of the session, over these tables."""
    spark = enriched.sparkSession
    for name, table in (
        (TICKERS, queries.q_tickers(trades)),
        (SUMMARY, queries.q_summary(enriched)),
        (CANDLES, queries.q_candles(enriched, None, bar_ns, mode)),
        (OBI_SERIES, queries.q_obi_series(imbalance)),
        (SENTIMENT, queries.q_sentiment(trades, imbalance)),
    ):
        _table_function(spark, name, table)


def register_landed(spark: SparkSession, data_dir: str) -> None:
    """The functions over the landed tables and their signals."""
    enriched = jobs.load_enriched(spark, data_dir)
    register(enriched, enriched, jobs.load_imbalance(spark, data_dir))
