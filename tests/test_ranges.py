from datetime import timedelta

import pytest
from core_cases import START, plan_of, rows_of
from pyspark.sql import functions as F

from tickloom.operators import ranges, stats
from tickloom.operators.candles import ohlcv
from tickloom.plans.layouts import QUERIES, Layouts, query, register_views
from tickloom.operators.buckets import bucket_vwap, pack
from tickloom.operators.candles import rollup
from tickloom.sources import tables, trades

ON_TICK = START + timedelta(seconds=3)


def test_closed_and_half_open_ends(feed):
    closed = ranges.in_range(feed, START, ON_TICK)
    half_open = ranges.in_range(feed, START, ON_TICK, closed=False)
    assert closed.count() - half_open.count() == 3


def test_range_reaches_the_scan(spark, feed, tmp_path):
    path = str(tmp_path / "ticks")
    tables.write_ticks(feed, path)
    stored = tables.scan_ticks(spark, path)
    found = ranges.in_range(stored, START, START + timedelta(seconds=1), "AAPL").select("price")
    plan = plan_of(found)
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "dt" in partition_filters
    assert "EqualTo(symbol,AAPL)" in pushed and "GreaterThanOrEqual(ts," in pushed
    assert "volume" not in plan.split("ReadSchema: ")[1].split("\n")[0]
    assert rows_of(found) == rows_of(ranges.in_range(feed, START, START + timedelta(seconds=1), "AAPL").select("price"))


def test_rows_land_in_their_own_day(spark, feed, tmp_path):
    path = str(tmp_path / "ticks")
    tables.write_ticks(feed, path, partitions=4)
    stored = tables.scan_ticks(spark, path)
    assert stored.where(F.to_date("ts") != F.col("dt")).count() == 0
    assert stored.select("dt").distinct().count() == 2
    assert rows_of(stored.drop("dt")) == rows_of(feed)


def test_files_are_clustered_by_symbol(spark, feed, tmp_path):
    path = str(tmp_path / "ticks")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_ticks(feed, path, partitions=6)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = tables.scan_ticks(spark, path).groupBy(F.input_file_name().alias("file")).agg(
        F.countDistinct("symbol").alias("symbols")
    ).collect()
    assert len(files) >= 4
    assert sum(row.symbols == 1 for row in files) >= len(files) // 2


def test_empty_input_gives_null_sums_and_zero_counts(feed):
    nothing = feed.where("symbol = 'NONE'")
    assert tuple(stats.volume(nothing, "NONE").first()) == (None, 0)
    assert stats.vwap(nothing, "NONE").first().vwap is None
    assert tuple(stats.extent(nothing).first()) == (None, None, None)
    assert stats.high_water(nothing).first().high_water is None
    assert stats.row_count(nothing).first().row_count == 0
    assert stats.volume(nothing).count() == 0


def test_vwap_without_volume_is_null(make_ticks):
    assert stats.vwap(make_ticks([(1, 0, "AAPL", "5.00", 0)]), "AAPL").first().vwap is None


def test_volatility_of_one_tick_is_null(make_ticks):
    assert stats.volatility(make_ticks([(1, 0, "AAPL", "5.00", 1)]), "price", "AAPL").first().volatility is None


def test_latest_price_breaks_ties(make_ticks):
    ticks = make_ticks([(1, 5, "AAPL", "1.00", 1), (3, 9, "AAPL", "3.00", 1), (2, 9, "AAPL", "2.00", 1)])
    assert str(stats.latest_price(ticks, "AAPL").first().price) == "3.00"
    assert str(stats.latest_price(ticks).first().price) == "3.00"
    assert "TakeOrdered" in plan_of(stats.latest_price(ticks, "AAPL"))


def test_layouts_agree_where_they_should(feed):
    seconds = ohlcv(feed, moments=True)  # some forms need the sums
    layouts = Layouts(feed, pack(feed), seconds, rollup(seconds))
    start, end = START.replace(second=0), START.replace(second=0) + timedelta(minutes=3)
    def run(name, layout):
        return query(name, layout, layouts, start, end, "AAPL").first()

    volumes = {run("volume", layout).total_volume for layout in ("raw", "packed", "candles")}
    assert len(volumes) == 1
    assert run("vwap", "raw").vwap == run("vwap", "packed").vwap
    assert run("latest_price", "raw").price == run("latest_price", "candles").close_price
    for name, layout in QUERIES:
        for symbol in ("AAPL", None):
            assert query(name, layout, layouts, start, end, symbol).count() >= 1


def test_forms_that_need_sums_say_so(feed):
    plain = Layouts(feed, None, ohlcv(feed), rollup(ohlcv(feed)))
    for name, layout in (("vwap", "candles"), ("mean_price", "candles"), ("tick_volatility", "candles"), ("volume", "any")):
        with pytest.raises(ValueError, match="moments=True"):
            query(name, layout, plain, START, START + timedelta(minutes=3))


def test_candle_range_is_newest_first(feed):
    found = ranges.candle_range(ohlcv(feed), START, ON_TICK, "AAPL").collect()
    times = [row.ts_bucket for row in found]
    assert times == sorted(times, reverse=True) and isinstance(found[0].open_price, float)


def test_historic_slice(feed):
    start = START + timedelta(milliseconds=500)
    found = trades.historic_slice(feed, start, 1).collect()
    assert {row.window_start for row in found} == {start}
    assert [row.seq for row in found] == sorted(row.seq for row in found)
    assert found[0].ts >= start


def test_second_batches(feed):
    batches = trades.second_batches(feed)
    assert batches.agg(F.sum("total_ticks")).first()[0] == feed.count()


def test_sql_over_views(spark, feed):
    register_views(Layouts(feed, None, ohlcv(feed)))
    found = spark.sql(
        """SELECT SUM(price * volume) / NULLIF(SUM(volume), 0) AS vwap, COUNT(*) AS n FROM raw_ticks
           WHERE symbol = :symbol AND ts BETWEEN :start AND :end""",
        args={"symbol": "AAPL", "start": START, "end": ON_TICK},
    ).first()
    wanted = ranges.in_range(feed, START, ON_TICK, "AAPL")
    assert found.n == wanted.count()
    assert abs(float(found.vwap) - stats.vwap(wanted, "AAPL").first().vwap) < 1e-6
    assert spark.sql("SELECT COUNT(*) AS n FROM ohlcv_1s").first().n == ohlcv(feed).count()


def test_double_prices_keep_their_fractions(feed, make_ticks):
    ticks = make_ticks([(1, 0, "AAPL", "1.00", 1), (2, 1, "AAPL", "1.00", 3)])
    doubles = ticks.withColumn("price", F.lit(1.0014))
    assert stats.mean_price(doubles).first().avg_price == pytest.approx(1.0014, rel=1e-12)
    assert stats.vwap(doubles).first().vwap == pytest.approx(1.0014, rel=1e-12)
    floats = feed.withColumn("price", F.col("price").cast("float"))
    for found, wanted in zip(rows_of(stats.mean_price(floats)), rows_of(stats.mean_price(feed)), strict=True):
        assert found[0] == wanted[0] and found[1] == pytest.approx(wanted[1], rel=1e-6)


def test_sums_of_the_largest_values_are_exact(spark, make_ticks):
    price, volume = "99999999.99", 2_000_000_000
    ticks = make_ticks([(i, i, "AAPL", price, volume) for i in range(1000)] + [(2000, 5, "MSFT", "-0.01", volume)])
    found = {row.symbol: row.vwap for row in stats.vwap(ticks).collect()}
    assert found == {"AAPL": float(price), "MSFT": -0.01}
    assert {row.symbol: row.vwap for row in bucket_vwap(pack(ticks), ["symbol"]).collect()} == found
    assert {row.symbol: row.avg_price for row in stats.mean_price(ticks).collect()} == found


def test_latest_price_of_all_symbols_is_one_pass(spark, feed, tmp_path):
    path = str(tmp_path / "t")
    tables.write_ticks(feed, path)
    plan = plan_of(stats.latest_price(tables.scan_ticks(spark, path)))
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan
