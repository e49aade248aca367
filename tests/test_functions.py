import math
import random
import statistics

from pyspark.sql import functions as F

from tickloom.functions import display, measures, times

MINUTE = times.MINUTE_NS


def _one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_bucket_rules(spark):
    stamps = [0, 29.9, 30, 59.9, 90, 150]
    table = spark.createDataFrame([(round(s * 1e9),) for s in stamps], "t bigint").orderBy("t")
    floor = [r[0] for r in table.select(times.bucket(F.col("t"), MINUTE)).collect()]
    rounded = [r[0] for r in table.select(times.bucket(F.col("t"), MINUTE, "round")).collect()]
    assert floor == [0, 0, 0, 0, 1, 2]
    assert rounded == [0, 0, 0, 1, 2, 2]


def test_hour_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert _one(spark, times.hour_of_day(F.lit(34_200 * 10**9))) == 9
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_large_nanoseconds_stay_exact(spark):
    stamp = 1_704_067_199_999_999_999
    assert _one(spark, times.seconds(F.lit(stamp))) == 1_704_067_199
    assert _one(spark, times.bucket(F.lit(stamp), MINUTE)) == stamp // MINUTE
    assert _one(spark, times.slice_start(F.lit(-1), 30)) == -30


def test_zero_denominators(spark):
    zero = F.lit(0)
    assert _one(spark, measures.imbalance(zero, zero)) is None
    assert _one(spark, measures.imbalance_eps(zero, zero)) == 0.0
    assert _one(spark, measures.ratio(F.lit(1), zero)) is None


def test_extreme_products_do_not_overflow(spark):
    top = F.lit(2**32 - 1)
    assert int(_one(spark, measures.notional(top, top))) == (2**32 - 1) ** 2
    assert int(_one(spark, measures.squared(top))) == (2**32 - 1) ** 2
    assert int(_one(spark, measures.order_key(F.lit(2**63 - 1), F.lit(2**63 - 1)))) == (
        (2**63 - 1) * 10**19 + 2**63 - 1
    )


def test_sample_stddev(spark):
    rng = random.Random(0)
    for base in (1, 10_000, 2**32 - 200):
        for n in (1, 2, 3, 100):
            ticks = [base + rng.randrange(200) for _ in range(n)]
            got = _one(
                spark,
                measures.sample_stddev(
                    F.lit(n).cast("bigint"),
                    F.lit(sum(ticks)).cast("bigint"),
                    F.lit(str(sum(t * t for t in ticks))).cast("decimal(38,0)"),
                ),
            )
            if n == 1:
                assert got is None
            else:
                exact = statistics.stdev(ticks) / 10_000
                assert math.isclose(got, exact, rel_tol=1e-12), (base, n)
    same = measures.sample_stddev(
        F.lit(3).cast("bigint"), F.lit(21).cast("bigint"), F.lit("147").cast("decimal(38,0)")
    )
    assert _one(spark, same) == 0.0


def test_display_rounds_like_printf(spark):
    values = [0.0, 0.125, 2.5, 1234.5, 1e6, 0.00015, 0.00025, 99.995, 1.005, -3.14159, 1234567.891]
    for v in values:
        assert _one(spark, display.dollars(F.lit(v))) == f"${v:.2f}"
        assert _one(spark, display.dollars(F.lit(v), 4)) == f"${v:.4f}"
        assert _one(spark, display.grouped(F.lit(v))) == f"{v:,.0f}"
        assert _one(spark, display.millions(F.lit(v))) == f"{v / 1e6:.1f}M"
        assert _one(spark, display.percent(F.lit(v))) == f"{v:.2f}%"
        assert _one(spark, display.signed(F.lit(v))) == ("+" if v > 0 else "") + f"{v:.4f}"


def test_arrows(spark):
    null = F.lit(None).cast("double")
    assert _one(spark, display.arrow(F.lit(0.1))) == "▲"
    assert _one(spark, display.arrow(F.lit(-0.1))) == "▼"
    assert _one(spark, display.arrow(F.lit(0.0))) == _one(spark, display.arrow(null)) == "●"
    assert _one(spark, display.trend(F.lit(0.0))) == "▲"


def test_clamp(spark):
    for value, wanted in [(-1.0, 0.0), (50.0, 50.0), (101.0, 100.0)]:
        assert _one(spark, measures.clamp(F.lit(value), 0.0, 100.0)) == wanted
