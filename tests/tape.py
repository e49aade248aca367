"""Small hand-made tables."""

from __future__ import annotations

TRADE = "stock string, ts_ns bigint, seq bigint, shares bigint, price_ticks bigint, price double"
ADD = (
    "stock string, stock_locate int, ts_ns bigint, seq bigint, side string, shares bigint, "
    "price_ticks bigint, price double"
)
BAR = (
    "stock string, minute_bucket bigint, market_cat string, volume bigint, vwap double, "
    "avg_price double, trade_count bigint"
)
S = 1_000_000_000


def trades(spark, *rows):
    """Rows of (stock, ts_ns, seq, shares, price)."""
    return spark.createDataFrame(
        [(s, t, n, q, round(p * 10000), float(p)) for s, t, n, q, p in rows], TRADE
    )


def adds(spark, *rows):
    """Rows of (stock, ts_ns, seq, side, shares, price)."""
    return spark.createDataFrame(
        [(s, 1, t, n, d, q, round(p * 10000), float(p)) for s, t, n, d, q, p in rows], ADD
    )


def bars(spark, *rows):
    """Rows of (stock, minute_bucket, market_cat, volume, avg_price)."""
    return spark.createDataFrame(
        [(s, m, c, v, float(p), float(p), 1) for s, m, c, v, p in rows], BAR
    )


def column(df, *names):
    """Values of the last column, keyed by the others."""
    out = {}
    for row in df.select(*names).collect():
        key = row[0] if len(names) == 2 else tuple(row[:-1])
        assert key not in out, key
        out[key] = row[-1]
    return out


def frame(payload: bytes) -> bytes:
    return len(payload).to_bytes(2, "big") + payload


def header(kind: str, locate: int, ts: int) -> bytes:
    return kind.encode() + locate.to_bytes(2, "big") + b"\0\0" + ts.to_bytes(6, "big")


def directory(locate: int, ts: int, stock: bytes, category: bytes) -> bytes:
    return header("R", locate, ts) + stock.ljust(8) + category


def order(
    kind: str, locate: int, ts: int, ref: int, side: str, shares: int, stock: bytes, ticks: int
) -> bytes:
    return (
        header(kind, locate, ts)
        + ref.to_bytes(8, "big")
        + side.encode()
        + shares.to_bytes(4, "big")
        + stock.ljust(8)
        + ticks.to_bytes(4, "big")
    )
