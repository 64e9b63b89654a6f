"""Exact sums carried by candles, and ranges split over tables."""

import random
import statistics
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from core_cases import START, plan_of, rows_of
from tickloom.operators import candles, stats
from tickloom.operators.ranges import in_range
from tickloom.plans import anyrange
from tickloom.plans.layouts import Layouts, query
from tickloom.sources import tables

US = timedelta(microseconds=1)


def with_sums(ticks):
    seconds = candles.ohlcv(ticks, moments=True)
    return Layouts(ticks, None, seconds, candles.rollup(seconds))


def test_sums_are_the_same_at_any_resolution(feed):
    direct = candles.ohlcv(feed, "1 minute", moments=True)
    rolled = candles.rollup(candles.ohlcv(feed, moments=True), "1 minute")
    assert rows_of(direct.select(*rolled.columns)) == rows_of(rolled)
    found = {r.symbol: r for r in candles.tick_statistics(rolled, ["symbol"]).collect()}
    for wanted, column in ((stats.mean_price(feed), "avg_price"), (stats.vwap(feed), "vwap")):
        assert {r.symbol: r[column] for r in wanted.collect()} == {s: r[column] for s, r in found.items()}
    for symbol, volatility in stats.volatility(feed, "price").collect():
        assert found[symbol].volatility == pytest.approx(volatility, rel=1e-12)


def test_volatility_keeps_its_digits_far_from_zero(make_ticks):
    prices = ["99999999.97", "99999999.98", "99999999.99", "99999999.97"]
    ticks = make_ticks([(i, i * 700, "BIG", p, 2_000_000_000) for i, p in enumerate(prices)] + [(9, 0, "ONE", "-5.25", 0), (10, 0, "SAME", "0.10", 1), (11, 1, "SAME", "0.10", 1)])
    found = {r.symbol: r for r in candles.tick_statistics(candles.rollup(candles.ohlcv(ticks, moments=True)), ["symbol"]).collect()}
    assert found["BIG"].volatility == pytest.approx(float(statistics.stdev(map(Decimal, prices))), rel=1e-12)
    assert found["ONE"].volatility is None and found["ONE"].vwap is None and found["ONE"].avg_price == -5.25
    assert found["SAME"].volatility == 0.0
    negative = make_ticks([(i, i, "NEG", p, 1) for i, p in enumerate(["-10.01", "3.37", "-99999999.99", "0.00"])])
    row = candles.tick_statistics(candles.ohlcv(negative, moments=True), ["symbol"]).first()
    assert row.volatility == pytest.approx(float(statistics.stdev(map(Decimal, ["-10.01", "3.37", "-99999999.99", "0.00"]))), rel=1e-9)


def test_cover_takes_the_widest_buckets_and_leaves_nothing_out():
    random_ = random.Random(4)
    widths = (anyrange.SECOND, anyrange.MINUTE)
    day = datetime(1969, 12, 31, 23, 0)
    for _ in range(500):
        start = day + timedelta(microseconds=random_.choice([1, 1000, 500_000, 1_000_000, 60_000_000]) * random_.randrange(7200))
        end = start + timedelta(microseconds=random_.choice([0, 1, 999_999, 1_000_000, 59_999_999, 300_000_000]) + random_.randrange(3) * 250_000)
        parts = anyrange.cover(start, end, widths)
        edges = [start, *[high for _, _, high in parts]]
        assert [low for _, low, _ in parts] == edges[:-1] and (edges[-1] == end or not parts)
        for width, low, high in parts:
            assert low < high and (width is None or not (low - anyrange.EPOCH) % width and not (high - anyrange.EPOCH) % width)
        assert sum((high - low for width, low, high in parts if width is None), timedelta()) < 2 * anyrange.SECOND
        assert sum((high - low for width, low, high in parts if width == anyrange.SECOND), timedelta()) < 2 * anyrange.MINUTE


@pytest.mark.parametrize("low,high", [(0, 19_900), (2_450, 4_450), (150, 149), (300, 350), (1_000, 2_999), (0, 2_000), (1_999, 15_001), (450, 450)])
def test_any_range_equals_ticks(feed, low, high):
    start, end = START + timedelta(milliseconds=low), START + timedelta(milliseconds=high)
    found = anyrange.range_candle(with_sums(feed), start, end)
    inside = in_range(feed, start, end)
    whole = candles.ohlcv(inside, "30 days")
    wanted = whole.join(stats.vwap(inside), "symbol").join(stats.mean_price(inside), "symbol")
    columns = ["symbol", "open_price", "high_price", "low_price", "close_price", "tick_count", "vwap", "avg_price"]
    assert rows_of(found.select(*columns, "total_volume")) == rows_of(wanted.select(*columns, F.col("volume").alias("total_volume")))
    for name, column in (("volume", "total_volume"), ("vwap", "vwap"), ("mean_price", "avg_price")):
        layouts = with_sums(feed)
        assert rows_of(query(name, "any", layouts, start, end).select("symbol", column)) == rows_of(query(name, "raw", layouts, start, end).select("symbol", column))


def test_only_two_seconds_of_ticks_are_read(spark, feed, tmp_path):
    long = feed.withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, seq DIV 4, 0)"))  # a hundred minutes
    tables.write_ticks(long, str(tmp_path / "ticks"))
    seconds = candles.ohlcv(long, moments=True)
    tables.write_candles(seconds, str(tmp_path / "ohlcv_1s"))
    tables.write_candles(candles.rollup(seconds), str(tmp_path / "ohlcv_1m"))
    stored = Layouts(tables.scan_ticks(spark, str(tmp_path / "ticks")), None, tables.scan_candles(spark, str(tmp_path), "1 second", moments=True),
                     tables.scan_candles(spark, str(tmp_path), "1 minute", moments=True))
    start, end = START + timedelta(seconds=100, milliseconds=300), START + timedelta(minutes=90, milliseconds=700)
    parts = anyrange.cover(start, end + US, (anyrange.SECOND, anyrange.MINUTE))
    assert [width for width, _, _ in parts] == [None, anyrange.SECOND, anyrange.MINUTE, anyrange.SECOND, None]
    found = anyrange.range_candle(stored, start, end)
    assert rows_of(found.select("symbol", "total_volume", "tick_count")) == rows_of(stats.volume(in_range(long, start, end)))
    scans = [line for line in plan_of(found).split("\n") if "PushedFilters" in line and "seq" in line]
    assert len(scans) == 2 and all("GreaterThanOrEqual(ts" in line and "LessThan(ts" in line for line in scans)


def test_ticks_are_read_where_candles_are_not_complete(feed):
    layouts = with_sums(feed)
    stale = Layouts(feed, None, layouts.candles_1s.where(F.col("ts_bucket") < F.lit(str(START + timedelta(seconds=10)))), None)
    until = START + timedelta(seconds=10, milliseconds=400)
    found = anyrange.range_candle(stale, START, START + timedelta(seconds=15), until=until)
    assert rows_of(found.select("symbol", "total_volume", "tick_count")) == rows_of(stats.volume(in_range(feed, START, START + timedelta(seconds=15))))


def test_candles_without_sums_are_refused(feed):
    plain = Layouts(feed, None, candles.ohlcv(feed), None)
    with pytest.raises(ValueError, match="moments=True"):
        anyrange.range_candle(plain, START, START + timedelta(seconds=5))
