from datetime import timedelta

from core_cases import START, plan_of, rows_of
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import buckets, stats
from tickloom.operators.candles import ohlcv
from tickloom.plans import storage
from tickloom.sources import compact, event_feed, listing, tables

TICK = ["seq", "ts", "symbol", "price", "volume"]
CANDLE = ["ts_bucket", "symbol", "open_price", "high_price", "low_price", "close_price", "volume", "tick_count"]


def test_round_trip(feed):
    assert rows_of(buckets.unpack(buckets.pack(feed)).select(*TICK)) == rows_of(feed)


def test_round_trip_of_coarse_buckets(feed):
    assert rows_of(buckets.unpack(buckets.pack(feed, "1 minute")).select(*TICK)) == rows_of(feed)


def test_detail_below_a_millisecond_is_lost(make_ticks):
    ticks = make_ticks([(1, 5, "AAPL", "1.00", 1)])
    fine = ticks.withColumn("ts", F.expr("ts + INTERVAL '0.0009' SECOND"))
    assert buckets.unpack(buckets.pack(fine)).first().ts == START + timedelta(milliseconds=5)


def test_inexact_prices_survive_as_cents(make_ticks):
    ticks = make_ticks([(1, 0, "AAPL", "130999.99", 1), (2, 1, "AAPL", "0.10", 1), (3, 2, "AAPL", "1499.37", 1)])
    assert rows_of(buckets.unpack(buckets.pack(ticks)).select(*TICK)) == rows_of(ticks)


def test_crowded_bucket_is_cut_into_bounded_rows(feed):
    packed = buckets.pack(feed.withColumn("symbol", F.lit("AAPL")), "1 minute", part_size=16)
    sizes = [row.n for row in packed.select(F.size("prices").alias("n")).collect()]
    assert max(sizes) <= 16 and sum(sizes) == 400


def test_rows_of_a_bucket_are_read_together(feed):
    cut, whole = buckets.pack(feed, part_size=7), buckets.pack(feed)
    assert cut.count() > whole.count()
    assert rows_of(buckets.ohlcv_from_buckets(cut).select(*CANDLE)) == rows_of(ohlcv(feed).select(*CANDLE))
    volumes = [rows_of(buckets.bucket_volume(df, ["symbol"]).drop("bucket_count")) for df in (cut, whole)]
    assert volumes[0] == volumes[1] == rows_of(stats.volume(feed))
    assert buckets.bucket_volume(cut, []).first().bucket_count == whole.count()
    assert rows_of(buckets.bucket_vwap(cut, ["symbol"])) == rows_of(stats.vwap(feed))


def test_merge_combines_pieces_and_keeps_rows_bounded(feed):
    pieces = buckets.pack(feed.where("seq % 2 = 0")).unionByName(buckets.pack(feed.where("seq % 2 = 1")))
    assert rows_of(buckets.merge_buckets(pieces)) == rows_of(buckets.pack(feed))
    assert rows_of(buckets.merge_buckets(pieces, part_size=7)) == rows_of(buckets.pack(feed, part_size=7))


def test_a_bucket_appended_twice_changes_nothing(feed):
    packed = buckets.pack(feed)
    twice = packed.unionByName(packed.where("symbol = 'AAPL'"))
    assert rows_of(buckets.merge_buckets(twice)) == rows_of(packed)


def test_merge_is_one_shuffle_of_arrays(feed):
    packed = buckets.pack(feed).checkpoint()
    pieces = packed.unionByName(packed.where("symbol = 'AAPL'"))
    plan = plan_of(buckets.merge_buckets(pieces))
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_merge_of_overlapping_pieces_counts_each_tick_once(feed):
    pieces = [feed.where(F.col("seq").between(low, low + 199)) for low in (0, 100, 150, 300)]
    packed = [buckets.pack(piece) for piece in pieces]
    whole = packed[0].unionByName(packed[1]).unionByName(packed[2]).unionByName(packed[3])
    columns = [name for name in packed[0].columns]
    assert rows_of(buckets.merge_buckets(whole).select(*columns)) == rows_of(buckets.pack(feed).select(*columns))
    assert rows_of(buckets.merge_buckets(whole, part_size=7).select(*columns)) == rows_of(buckets.pack(feed, part_size=7).select(*columns))


def test_merge_into_coarser_buckets(feed):
    assert rows_of(buckets.merge_buckets(buckets.pack(feed), "1 minute")) == rows_of(buckets.pack(feed, "1 minute"))


def test_unmerged_pieces_are_one_bucket_on_request(feed):
    pieces = buckets.pack(feed.where("seq % 2 = 0")).unionByName(buckets.pack(feed.where("seq % 2 = 1")))
    found = buckets.bucket_volume(pieces, ["symbol"], pieces=True)
    assert rows_of(found) == rows_of(buckets.bucket_volume(buckets.pack(feed), ["symbol"]))
    assert plan_of(buckets.bucket_volume(pieces, ["symbol"])).count("Exchange hashpartitioning(symbol") == 1


def test_numbers_may_start_anywhere(feed):
    columns = ["bucket_ts", "symbol", "part", "prices", "volumes", "offsets_ms", "tick_count", "volume_sum", "notional_cents"]
    for part_size in (buckets.PART_SIZE, 5):
        wanted = rows_of(buckets.pack(feed, part_size=part_size).select(*columns))
        for shift in (1, 262_140, 262_144 * 7 - 3, 1 << 50):
            moved = buckets.pack(feed.withColumn("seq", F.col("seq") + shift), part_size=part_size)
            assert rows_of(moved.select(*columns)) == wanted
            assert buckets.bucket_volume(moved, []).first().bucket_count == ohlcv(feed).count()


def test_sums_need_no_arrays(spark, feed, tmp_path):
    path = str(tmp_path / "b")
    tables.write_buckets(buckets.pack(feed), path)
    stored = tables.scan_buckets(spark, path)
    for found in (buckets.bucket_volume(stored, ["symbol"]), buckets.bucket_vwap(stored, []), buckets.ohlcv_from_buckets(stored),
                  buckets.bucket_volume_by(stored, "1 minute", [])):
        scans = [line.split("ReadSchema: ")[1] for line in plan_of(found).split("\n") if "ReadSchema" in line]
        assert scans and not any("array" in line for line in scans)


def test_stored_rows_come_back(spark, feed, make_ticks, tmp_path):
    wide = make_ticks([
        (1 << 60, 0, "BIG", "99999999.99", 2_000_000_000), (5, 0, "BIG", "0.00", 2_000_000_000), (-(1 << 60), 0, "BIG", "12345678.90", 0),
        (7, 1, "BIG", "-0.01", 2_000_000_000), (8, 999, "BIG", "99999999.99", 7), (9, 999, "ONE", "-3.00", 0)])
    fine = feed.withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, 0.000001 * (seq % 900))"))
    old = feed.withColumn("ts", F.expr("ts - make_interval(90)"))
    for number, ticks in enumerate((feed, wide, fine, old)):
        for resolution in ("1 second", "1 day"):
            packed = buckets.pack(ticks, resolution, part_size=1000)
            path = str(tmp_path / f"{number}-{resolution[2:]}")
            tables.write_buckets(packed, path)
            assert rows_of(tables.scan_buckets(spark, path).drop("dt")) == rows_of(packed)


def test_stored_rows_of_two_ticks_keep_volumes_only(feed):
    stored = compact.compact(buckets.pack(feed))
    assert stored.schema.simpleString() == schemas.STORED_BUCKETS.simpleString()
    for row in stored.collect():
        assert len(row.price_steps) == len(row.seq_steps) == len(row.offset_steps) == max(row.tick_count - 2, 0)
        assert row.wide_price_steps is row.wide_seq_steps is row.wide_notional_rest is None


def test_packed_tables_are_smaller_than_ticks_in_every_codec(spark, tmp_path):
    """Half a million ticks on five days, as in the benchmark."""
    feed = event_feed.dense_ticks(event_feed.read_events(spark, "/root/testdata/sf0.1"))
    days = spark.range(5).withColumnRenamed("id", "day")
    shifted = feed.join(F.broadcast(days)).select(
        (F.col("seq") + F.col("day") * 1_000_000).alias("seq"), F.timestamp_add("DAY", F.col("day"), F.col("ts")).alias("ts"), "symbol", "price", "volume")
    storage.write_codecs(shifted, str(tmp_path))
    sizes = {r.table: r.bytes for r in listing.list_files(spark, str(tmp_path)).groupBy("table").agg(F.sum("length").alias("bytes")).collect()}
    for codec in storage.CODECS:
        assert sizes[f"buckets-{codec}"] < sizes[f"ticks-{codec}"], (codec, sizes)


def test_candles_of_pieces_equal_candles_of_ticks(feed):
    pieces = buckets.pack(feed.where("seq % 3 = 0")).unionByName(buckets.pack(feed.where("seq % 3 > 0")))
    assert rows_of(buckets.ohlcv_from_buckets(pieces).select(*CANDLE)) == rows_of(ohlcv(feed).select(*CANDLE))


def test_range_takes_whole_buckets_or_exact_ticks(feed):
    start, end = START + timedelta(milliseconds=2450), START + timedelta(milliseconds=4450)
    whole = buckets.bucket_range(buckets.pack(feed), start, end)
    assert {row.bucket_ts for row in whole.collect()} == {START + timedelta(seconds=s) for s in (3, 4)}
    exact = buckets.bucket_range_exact(buckets.pack(feed), start, end, "AAPL")
    wanted = feed.where((F.col("symbol") == "AAPL") & F.col("ts").between(F.lit(str(start)), F.lit(str(end))))
    assert rows_of(exact.select(*TICK)) == rows_of(wanted)


def test_volume_by_second_and_minute(feed):
    packed = buckets.pack(feed)
    by_minute = buckets.bucket_volume_by(packed, "1 minute", ["symbol"])
    assert rows_of(by_minute) == rows_of(stats.volume_by(feed, "1 minute"))
    assert buckets.bucket_volume_by(packed, "1 second", ["symbol"]).count() == packed.count()


def test_empty_range(feed):
    nothing = buckets.pack(feed).where("symbol = 'NONE'")
    row = buckets.bucket_volume(nothing, []).first()
    assert (row.total_volume, row.bucket_count, row.tick_count) == (None, 0, 0)
    assert buckets.bucket_vwap(nothing, []).first().vwap is None
