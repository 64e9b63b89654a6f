import pytest
from core_cases import plan_of, rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.operators.candles import mean_price_candles, ohlcv, rollup, second_activity
from tickloom.plans.layouts import Layouts, candles_at

COLUMNS = ["ts_bucket", "symbol", "open_price", "high_price", "low_price", "close_price", "volume", "tick_count"]


def test_ties_go_by_sequence_number(make_ticks):
    ticks = make_ticks([
        (9, 100, "AAPL", "9.00", 1), (3, 100, "AAPL", "3.00", 1), (5, 100, "AAPL", "5.00", 1), (1, 50, "MSFT", "1.00", 0),
    ])
    candle = ohlcv(ticks).where("symbol = 'AAPL'").first()
    assert (str(candle.open_price), str(candle.close_price)) == ("3.00", "9.00")


def test_time_beats_sequence_number(make_ticks):
    ticks = make_ticks([(9, 100, "AAPL", "9.00", 1), (3, 900, "AAPL", "3.00", 1)])
    candle = ohlcv(ticks).first()
    assert (str(candle.open_price), str(candle.close_price)) == ("9.00", "3.00")


@pytest.mark.parametrize("resolution", ["200 milliseconds", "1 second", "7 seconds", "1 minute", "1 day"])
def test_all_keys_agree(feed, resolution):
    wanted = rows_of(ohlcv(feed, resolution, "struct"))
    assert rows_of(ohlcv(feed, resolution)) == wanted
    if resolution in ("200 milliseconds", "1 second"):
        assert rows_of(ohlcv(feed, resolution, "long")) == wanted


def test_wide_key_takes_any_sequence_number(feed):
    moved = feed.withColumn("seq", F.col("seq") + (1 << 62))
    assert rows_of(ohlcv(moved)) == rows_of(ohlcv(feed))
    with pytest.raises(PySparkException, match="43 bits"):
        ohlcv(moved, key="long").collect()


def test_rollup_is_associative(feed):
    direct = rows_of(ohlcv(feed, "1 minute").select(*COLUMNS))
    once = rollup(ohlcv(feed, "1 second"), "1 minute")
    twice = rollup(rollup(ohlcv(feed, "1 second"), "5 seconds"), "1 minute")
    assert rows_of(once.select(*COLUMNS)) == direct
    assert rows_of(twice.select(*COLUMNS)) == direct


def test_candles_hold_their_bounds_and_volume(feed):
    candles = ohlcv(feed)
    inside = [f"{c} BETWEEN low_price AND high_price" for c in ("open_price", "close_price")]
    assert candles.where(f"NOT ({' AND '.join(inside)})").count() == 0
    total = feed.agg(F.sum("volume")).first()[0]
    assert candles.agg(F.sum("volume")).first()[0] == total
    assert candles.agg(F.sum("tick_count")).first()[0] == feed.count()
    assert second_activity(candles).agg(F.sum("total_ticks")).first()[0] == feed.count()


def test_candles_do_not_cross_midnight(feed):
    days = {row.ts_bucket.date() for row in ohlcv(feed, "1 hour").collect()}
    assert len(days) == 2


def test_mean_price_candles(make_ticks):
    ticks = make_ticks([(1, 0, "AAPL", "1.00", 1), (2, 1, "AAPL", "2.00", 1), (3, 2, "AAPL", "2.00", 1)])
    candle = mean_price_candles(ticks, "1 second").first()
    assert candle.open_price == candle.close_price == 5 / 3


def test_candles_come_from_the_coarsest_table(feed):
    seconds = ohlcv(feed)
    minutes = rollup(seconds)
    full = Layouts(feed, None, seconds.withColumn("volume", F.lit(1)), minutes.withColumn("volume", F.lit(2)))
    assert {row.volume for row in candles_at(full, "1 minute").collect()} == {2}
    assert candles_at(Layouts(feed, None, seconds), "1 hour").agg(F.sum("volume")).first()[0] == feed.agg(F.sum("volume")).first()[0]
    assert rows_of(candles_at(Layouts(feed), "1 minute")) == rows_of(ohlcv(feed, "1 minute"))


def test_hash_aggregate_with_partial_step(feed):
    plan = plan_of(ohlcv(feed))
    assert "SortAggregate" not in plan
    assert "partial_min_by" in plan
    assert "SortAggregate" in plan_of(ohlcv(feed, key="struct"))


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_session_zone_does_not_matter(spark, feed, zone):
    # In New York clocks went back at 02:00 on this day: an hour exists twice.
    moved = feed.withColumn("ts", F.expr("ts + (TIMESTAMP_NTZ'2024-11-03 01:59:50' - TIMESTAMP_NTZ'2024-04-11 23:59:58')"))
    jobs = [lambda: ohlcv(moved), lambda: ohlcv(moved, "1 hour"), lambda: ohlcv(moved, "1 day", "wide")]
    wanted = [rows_of(job()) for job in jobs]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert [rows_of(job()) for job in jobs] == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
