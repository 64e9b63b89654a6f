from datetime import timedelta
from decimal import Decimal

import pytest
from core_cases import START, plan_of, rows_of
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import keyed
from tickloom.functions.timecols import from_epoch_micros
from tickloom.operators import range_join
from tickloom.operators.range_join import window_counts, window_stats
from tickloom.sources import tables

WINDOWS = [
    (1, 0, 0),           # a single instant with ticks
    (2, 0, 999),         # just short of a whole second
    (3, 1000, 2000),     # a whole second and one instant
    (4, 150, 7650),      # both ends on ticks, inside seconds
    (5, 149, 151),
    (6, 500, 500),       # an instant without ticks
    (7, -9000, 60000),   # more than the data
    (8, 90000, 95000),   # after the data
    (9, 3000, 3999),
    (10, 2999, 4000),
]


@pytest.fixture
def windows(spark):
    return spark.createDataFrame(
        [(wid, START + timedelta(milliseconds=a), START + timedelta(milliseconds=b)) for wid, a, b in WINDOWS],
        "wid BIGINT, t1 TIMESTAMP_NTZ, t2 TIMESTAMP_NTZ",
    )


@pytest.mark.parametrize("resolution", ["1 second", "5 seconds", "1 minute"])
def test_counts_match_a_plain_join(feed, windows, resolution):
    plain = windows.join(feed, F.col("ts").between(F.col("t1"), F.col("t2")), "left")
    wanted = plain.groupBy("wid").agg(F.count("ts")).collect()
    found = window_counts(windows, feed, resolution).select("wid", "tick_count")
    assert rows_of(found) == sorted(tuple(row) for row in wanted)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_means_per_symbol_match_a_plain_join(spark, feed, windows, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = window_stats(windows, feed, by=["symbol"]).select("wid", "symbol", "tick_count", "price_sum")
        assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)
        got = rows_of(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    plain = windows.join(feed, F.col("ts").between(F.col("t1"), F.col("t2")))
    assert got == rows_of(plain.groupBy("wid", "symbol").agg(F.count("ts"), F.sum("price")))


def test_many_windows(spark, feed):
    start = F.timestamp_add("MILLISECOND", (F.col("wid") * 7919) % 30_000 - 3000, F.lit(str(START)).cast("timestamp_ntz"))
    many = spark.range(20_000).withColumnRenamed("id", "wid").withColumn("t1", start)
    many = many.withColumn("t2", F.timestamp_add("MILLISECOND", (F.col("wid") * 104_729) % 20_000 - 2000, F.col("t1")))
    found = window_counts(many, feed, chunk="5 seconds")
    assert "sequence(" not in plan_of(found)
    plain = many.join(feed, F.col("ts").between(F.col("t1"), F.col("t2")), "left").groupBy("wid").agg(F.count("ts"))
    assert rows_of(found.select("wid", "tick_count")) == rows_of(plain)


def test_windows_meet_only_values_that_trade_near_them(spark):
    """20,000 windows, 5,000 symbols of which three or four trade in any second."""
    ticks = spark.range(50_000).select(
        F.col("id").alias("seq"), F.timestamp_add("MILLISECOND", F.col("id") * 300, F.lit(str(START)).cast("timestamp_ntz")).alias("ts"),
        F.concat(F.lit("S"), F.expr("(id DIV 10 * 7919) % 5000")).alias("symbol"), F.lit("1.25").cast("decimal(10,2)").alias("price"), F.lit(1).alias("volume"))
    windows = spark.range(20_000).select(
        F.col("id").alias("wid"), F.timestamp_add("MILLISECOND", F.col("id") * 733, F.lit(str(START)).cast("timestamp_ntz")).alias("t1"))
    windows = windows.withColumn("t2", F.timestamp_add("MILLISECOND", F.expr("wid % 9 * 1500"), F.col("t1")))
    found = window_stats(windows, ticks, by=["symbol"]).groupBy().agg(F.count("*").alias("rows"), F.sum("tick_count").alias("ticks")).first()
    inside = F.col("ts").between(F.col("t1"), F.col("t2"))
    hours = lambda column: F.expr(f"unix_micros(CAST({column} AS TIMESTAMP)) DIV 16000000")
    near = windows.withColumn("h", F.explode(F.sequence(hours("t1"), hours("t2")))).join(ticks.withColumn("h", hours("ts")), "h").where(inside)
    wanted = near.groupBy("wid", "symbol").count().groupBy().agg(F.count("*").alias("rows"), F.sum("count").alias("ticks")).first()
    assert found == wanted and found.rows > 20_000
    pieces = range_join._pieces(windows, 1_000_000, 2).groupBy("wid").count().agg(F.max("count")).first()[0]
    assert pieces <= 2 + 2 * (range_join.CELLS - 1) and "collect_set" not in plan_of(window_stats(windows, ticks, by=["symbol"]))


def test_pieces_cover_a_window_once(spark):
    """Windows before and after 1970 and of any length, cut or not."""
    rows = [(start, start + length) for start in (-7_000_001, -3_000_000, 0, 1, 999_999, 1_000_000, 12_345_678, 64_000_000)
            for length in (0, 1, 999_998, 999_999, 1_000_000, 7_999_999, 9_000_001, 70_000_000, 599_999_999, 3_600_000_000)]
    windows = spark.createDataFrame(rows, "a long, b long").select("a", "b", from_epoch_micros(F.col("a")).alias("t1"), from_epoch_micros(F.col("b")).alias("t2"))
    pieced = range_join._pieces(windows, 1_000_000, 5).groupBy("a", "b").agg(F.collect_list(F.struct("_level", "_cell")))
    for a, b, pieces in pieced.collect():
        spans = []
        for level, cell in pieces:
            size = 1_000_000 * range_join.CELLS ** max(level, 0)
            low, high = cell * size, cell * size + size
            spans.append((max(low, a), min(high, b + 1)) if level == range_join.EDGE else (low, high))
        spans.sort()
        assert spans[0][0] == a and spans[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_windows_upside_down_hold_nothing(feed, windows):
    turned = windows.select("wid", F.col("t2").alias("t1"), F.col("t1").alias("t2"))
    found = {row.wid: row.tick_count for row in window_counts(turned, feed).collect()}
    assert set(found) == {row[0] for row in WINDOWS}
    assert all(found[wid] == 0 for wid, a, b in WINDOWS if a < b) and found[1] > 0
    assert window_counts(turned.where("wid = 4"), feed).first().tick_count == 0


def test_window_sums_of_double_prices(feed, windows):
    doubles = feed.withColumn("price", F.col("price").cast("double") + 0.0007)
    plain = windows.join(doubles, F.col("ts").between(F.col("t1"), F.col("t2"))).groupBy("wid").agg(F.avg("price").alias("m"))
    wanted = {row.wid: row.m for row in plain.collect()}
    found = {row.wid: row.avg_price for row in window_stats(windows, doubles).collect()}
    assert found == pytest.approx(wanted, rel=1e-9)


def test_only_touched_days_are_read(spark, feed, windows, tmp_path):
    tables.write_ticks(feed, str(tmp_path / "t"))
    stored = tables.scan_ticks(spark, str(tmp_path / "t"))
    found = window_stats(windows.where("wid = 1"), stored)
    assert "dt" in plan_of(found).split("PartitionFilters: [")[1].split("]")[0]
    assert "Cartesian" not in plan_of(window_stats(windows, stored, by=["symbol"]))
    assert found.first().tick_count == 3


def test_no_windows(feed, windows):
    assert window_stats(windows.where("wid < 0"), feed).count() == 0


def test_rejects_name_the_first_reason(spark, feed):
    ticks = feed.withColumn("volume", F.nullif("volume", F.lit(0)))
    known = schemas.symbols(spark).where("symbol <> 'TSLA'")
    required = ["ts", "symbol", "price", "volume"]
    rejects = keyed.rejected(ticks, known, required)
    accepted = keyed.accepted(ticks, known, required)
    assert rejects.count() + accepted.count() == feed.count()
    assert {row.reason for row in rejects.collect()} == {"null value", "unknown symbol"}
    assert accepted.where("symbol = 'TSLA' OR volume IS NULL").count() == 0
    missing = ticks.withColumn("symbol", F.lit(None).cast("string"))
    assert keyed.rejected(missing, known, required).count() == feed.count()


@pytest.fixture
def table(spark):
    def build(rows):
        return spark.createDataFrame(rows, "k STRING, v INT, at INT")

    return build


def test_first_write_wins(table):
    stored = table([("a", 1, 0)])
    new = table([("a", 9, 5), ("b", 2, 7), ("b", 3, 6), ("c", 4, 1)])
    added = keyed.insert_if_absent(new, stored, ["k"], order=["at"])
    assert rows_of(added) == [("b", 3, 6), ("c", 4, 1)]


def test_last_write_wins_and_may_go_back(table):
    stored = table([("a", 5, 5), ("z", 1, 1)])
    updates = table([("a", 9, 1), ("a", 3, 2), ("b", 2, 1)])
    assert rows_of(keyed.upsert(stored, updates, ["k"], ["at"])) == [("a", 3, 2), ("b", 2, 1), ("z", 1, 1)]


def test_picks_are_made_before_the_shuffle(table):
    for found in (keyed.newest_per_key(table([("a", 1, 0)]), ["k"], ["at"]), keyed.first_per_key(table([("a", 1, 0)]), ["k"], ["at"])):
        assert "SortAggregate" not in plan_of(found) and "WindowGroupLimit" in plan_of(found)


def test_append_candles_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    price = Decimal("1.00")
    rows = [(START + timedelta(seconds=i), "AAPL", price, price, price, price, i, 1) for i in range(5)]
    candles = spark.createDataFrame(rows, schemas.CANDLES)
    period = (START, START + timedelta(seconds=5))
    keyed.append_candles(spark, candles.limit(3), path, period)
    keyed.append_candles(spark, candles.withColumn("volume", F.lit(99).cast("bigint")), path, period)
    keyed.append_candles(spark, candles, path, period)
    stored = spark.read.parquet(path)
    assert stored.count() == 5
    assert sorted(row.volume for row in stored.collect())[-1] == 99
    assert stored.where("volume = 99").count() == 2


def test_append_after_a_failed_first_write(spark, tmp_path):
    path = tmp_path / "c"
    (path / "_temporary" / "0").mkdir(parents=True)
    price = Decimal("1.00")
    candles = spark.createDataFrame([(START, "AAPL", price, price, price, price, 1, 1)], schemas.CANDLES)
    keyed.append_candles(spark, candles, str(path), (START, START))
    assert spark.read.parquet(str(path)).count() == 1
