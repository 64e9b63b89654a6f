"""One function per registered query: (spark, sf_dir) -> DataFrame.

Range queries cover three quarters of the data extent for all symbols; a few
take one symbol, where that is the operator.
"""

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog.inputs import (
    bucket_text, data_extent, layouts_of, metrics_of, midpoint_of, minutes_of, period_of, quarters_of, report,
    sparse_of, ticks_of, windows_over,
)
from tickloom import schemas
from tickloom.functions.timecols import ntz, tumbling
from tickloom.operators import buckets, candles, keyed, metrics, moving, ranges, stats
from tickloom.operators.kpis import kpis
from tickloom.operators.range_join import window_counts, window_stats
from tickloom.plans import incremental, storage
from tickloom.plans.anyrange import range_candle
from tickloom.plans.layouts import Layouts, candles_at, query
from tickloom.session import shared_dir
from tickloom.sources import compact, event_feed, tables, text, trades
from tickloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SYMBOL = "AAPL"


def register(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, sf_dir: report(build(spark, sf_dir))
    return build


# --- sources, sinks and layout ------------------------------------------------


@register
def tick_scan(spark, sf_dir):
    path = shared_dir(spark, "ticks")
    tables.write_ticks(ticks_of(spark, sf_dir), path)
    return tables.scan_ticks(spark, path).select("seq", "ts", "symbol", "price", "volume")


@register
def candle_scan(spark, sf_dir):
    root = shared_dir(spark, "candles")
    for resolution, frame in (("1 second", layouts_of(ticks_of(spark, sf_dir)).candles_1s),
                              ("1 minute", layouts_of(ticks_of(spark, sf_dir)).candles_1m)):
        tables.write_candles(frame, f"{root}/{schemas.CANDLE_TABLES[resolution]}")
    seconds = tables.scan_candles(spark, root, "1 second").withColumn("resolution", F.lit("1s"))
    minutes = tables.scan_candles(spark, root, "1 minute").withColumn("resolution", F.lit("1m"))
    return seconds.unionByName(minutes).drop("dt")


@register
def load_tsv_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "tsv")
    text.write_tsv(ticks_of(spark, sf_dir), path)
    return text.load_tsv(spark, path).select("symbol", "price", "volume", "ts")


@register
def load_tsv_candles(spark, sf_dir):
    """Candles of ticks that were written as text and numbered again on loading."""
    path = shared_dir(spark, "tsv")
    text.write_tsv(ticks_of(spark, sf_dir), path)
    return candles.ohlcv(text.load_tsv(spark, path))


@register
def clock_labels(spark, sf_dir):
    """Ticks per minute of the day, by label; the label read back as a time, one that is none as 09:30."""
    minutes = ticks_of(spark, sf_dir).select(text.clock_label("ts").alias("label"), "symbol")
    odd = F.when(F.col("symbol") == SYMBOL, F.concat(F.lit("at "), "label")).otherwise(F.col("label"))
    parsed = minutes.withColumn("said", odd).withColumn("second_of_day", text.clock_time("said", "09:30"))
    return parsed.groupBy("label", "second_of_day").agg(F.count(F.lit(1)).alias("tick_count"))


@register
def daily_partition_counts(spark, sf_dir):
    path = shared_dir(spark, "ticks")
    tables.write_ticks(ticks_of(spark, sf_dir), path)
    return tables.scan_ticks(spark, path).groupBy("dt").agg(F.count(F.lit(1)).alias("tick_count"))


@register
def bucket_partition_counts(spark, sf_dir):
    path = shared_dir(spark, "buckets")
    tables.write_buckets(buckets.pack(ticks_of(spark, sf_dir)), path)
    stored = tables.scan_buckets(spark, path)
    return stored.groupBy("dt").agg(
        F.count(F.lit(1)).alias("bucket_rows"), F.sum(F.size("prices")).alias("tick_count")
    )


@register
def historic_slice(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    start, end = period_of(ticks)
    return trades.historic_slice(ticks, start, (end - start) // timedelta(minutes=1))


@register
def second_batches(spark, sf_dir):
    return trades.second_batches(ticks_of(spark, sf_dir))


# --- filters ----------------------------------------------------------------------


@register
def range_scan(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    return ranges.in_range(ticks, *period_of(ticks), SYMBOL)


@register
def half_open_range(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    return ranges.in_range(ticks, *period_of(ticks), closed=False)


@register
def symbol_scan(spark, sf_dir):
    return ranges.of_symbol(ticks_of(spark, sf_dir), SYMBOL)


@register
def bucket_lookup(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    found = ranges.bucket_at(buckets.pack(ticks), midpoint_of(ticks))
    return bucket_text(found)


@register
def bucket_range_scan(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    start, end = period_of(ticks)
    half = timedelta(milliseconds=500)
    return bucket_text(buckets.bucket_range(buckets.pack(ticks), start + half, end + half))


@register
def bucket_range_exact(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    start, end = period_of(ticks)
    half = timedelta(milliseconds=500)
    return buckets.bucket_range_exact(buckets.pack(ticks), start + half, end + half)


@register
def candle_range_scan(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    return ranges.candle_range(candles.ohlcv(ticks), *period_of(ticks), SYMBOL)


# --- candles and aggregates -------------------------------------------------------


@register
def ohlcv_1s(spark, sf_dir):
    return candles.ohlcv(ticks_of(spark, sf_dir), "1 second")


@register
def ohlcv_1m(spark, sf_dir):
    return candles.rollup(candles.ohlcv(ticks_of(spark, sf_dir), "1 second"), "1 minute")


@register
def ohlcv_1h(spark, sf_dir):
    return candles.ohlcv(sparse_of(spark, sf_dir), "1 hour")


@register
def ohlcv_1d(spark, sf_dir):
    hours = candles.rollup(candles.ohlcv(sparse_of(spark, sf_dir), "1 second"), "1 hour")
    return candles.rollup(hours, "1 day")


@register
def candles_any_resolution(spark, sf_dir):
    layouts = layouts_of(ticks_of(spark, sf_dir))
    found = None
    for resolution in ("500 milliseconds", "30 seconds", "5 minutes"):
        made = candles_at(layouts, resolution).withColumn("resolution", F.lit(resolution))
        found = made if found is None else found.unionByName(made)
    return found


@register
def ohlcv_from_buckets(spark, sf_dir):
    return buckets.ohlcv_from_buckets(buckets.pack(ticks_of(spark, sf_dir)))


@register
def avg_candle_1s(spark, sf_dir):
    return candles.mean_price_candles(ticks_of(spark, sf_dir), "1 second")


@register
def avg_candle_1m(spark, sf_dir):
    return candles.mean_price_candles(ticks_of(spark, sf_dir), "1 minute")


@register
def second_activity(spark, sf_dir):
    return candles.second_activity(candles.ohlcv(ticks_of(spark, sf_dir)))


@register
def pack_buckets(spark, sf_dir):
    """Rows of at most four ticks, so that many buckets are cut."""
    return bucket_text(buckets.pack(ticks_of(spark, sf_dir), part_size=4))


@register
def unpack_buckets(spark, sf_dir):
    return buckets.unpack(buckets.pack(ticks_of(spark, sf_dir)))


@register
def merge_buckets(spark, sf_dir):
    """Two feeds packed apart, cut inside a second, then merged."""
    ticks = ticks_of(spark, sf_dir)
    cut = ntz(midpoint_of(ticks) + timedelta(milliseconds=400))
    early, late = ticks.where(F.col("ts") < cut), ticks.where(F.col("ts") >= cut)
    return bucket_text(buckets.merge_buckets(buckets.pack(late).unionByName(buckets.pack(early))))


@register
def merge_twice_appended(spark, sf_dir):
    """The second half of the buckets is there twice."""
    ticks = ticks_of(spark, sf_dir)
    packed = buckets.pack(ticks)
    again = packed.where(F.col("bucket_ts") >= ntz(midpoint_of(ticks)))
    return buckets.bucket_volume(buckets.merge_buckets(packed.unionByName(again)), ["symbol"])


@register
def vwap_double_prices(spark, sf_dir):
    """VWAP and mean of prices with fractions of a cent."""
    ticks = ticks_of(spark, sf_dir).withColumn("price", F.col("price").cast("double") * 1.00037)
    both = stats.vwap(ticks).join(stats.mean_price(ticks), "symbol")
    return both.select("symbol", F.round("vwap", 8).alias("vwap"), F.round("avg_price", 8).alias("avg_price"))


@register
def symbol_avg_range(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    return stats.mean_price(ranges.in_range(ticks, *period_of(ticks)))


@register
def range_count(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    return stats.row_count(ranges.in_range(ticks, *period_of(ticks)))


@register
def extent(spark, sf_dir):
    return stats.extent(ticks_of(spark, sf_dir))


@register
def high_water(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    raw = stats.high_water(ticks).withColumn("layout", F.lit("raw"))
    packed = stats.high_water(buckets.pack(ticks), "bucket_ts").withColumn("layout", F.lit("packed"))
    return raw.unionByName(packed)


@register
def bucket_second_volume(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    packed = ranges.in_range(buckets.pack(ticks), *period_of(ticks), time="bucket_ts")
    return buckets.bucket_volume_by(packed, "1 second", ["symbol"])


@register
def kpi_block(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    found = kpis(ranges.in_range(candles.ohlcv(ticks), *period_of(ticks), time="ts_bucket"))
    return found.withColumn("volatility", F.round("volatility", 8))


QUERIES["kpis"] = QUERIES.pop("kpi_block")


# --- named queries on each layout ---------------------------------------------------


def _named(key: str, name: str, layout: str, whole_minutes: bool = False, rounded: str | None = None) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        ticks = ticks_of(spark, sf_dir)
        period = minutes_of(ticks) if whole_minutes else period_of(ticks)
        found = query(name, layout, layouts_of(ticks), *period)
        if layout == "packed" and name == "time_range":
            found = bucket_text(found)
        return report(found.withColumn(rounded, F.round(rounded, 8)) if rounded else found)

    QUERIES[key] = build


_named("time_range_raw", "time_range", "raw")
_named("time_range_packed", "time_range", "packed")
_named("minute_scan", "ohlc_scan", "raw")
_named("candle_minute_scan", "ohlc_scan", "candles", whole_minutes=True)
_named("range_volume", "volume", "raw")
_named("bucket_volume", "volume", "packed")
_named("candle_volume", "volume", "candles", whole_minutes=True)
_named("latest_price", "latest_price", "raw")
_named("latest_close", "latest_price", "candles")
_named("volatility_raw", "volatility", "raw", rounded="volatility")
_named("volatility_candles", "volatility", "candles", whole_minutes=True, rounded="volatility")
_named("vwap", "vwap", "raw")
_named("bucket_vwap", "vwap", "packed")
_named("minute_volume", "minute_rollup", "raw")
_named("bucket_minute_volume", "minute_rollup", "packed")


def _with_sums(ticks: DataFrame) -> Layouts:
    """Candles that carry exact sums, the minutes rolled up from the seconds."""
    seconds = candles.ohlcv(ticks, "1 second", moments=True)
    return Layouts(ticks, None, seconds, candles.rollup(seconds, "1 minute"))


@register
def tick_statistics_from_candles(spark, sf_dir):
    """Mean price, VWAP and volatility of the ticks of whole minutes, without reading them."""
    ticks = ticks_of(spark, sf_dir)
    minutes = ranges.in_range(_with_sums(ticks).candles_1m, *minutes_of(ticks), time="ts_bucket")
    return candles.tick_statistics(minutes, ["symbol"]).withColumn("volatility", F.round("volatility", 8))


@register
def any_range_candle(spark, sf_dir):
    """A range with ends inside seconds: minutes, seconds and the ticks of two seconds."""
    ticks = ticks_of(spark, sf_dir)
    start, end = period_of(ticks)
    found = range_candle(_with_sums(ticks), start + timedelta(milliseconds=730), end + timedelta(milliseconds=410))
    return found.withColumn("volatility", F.round("volatility", 8))


@register
def any_range_volume(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    start, end = period_of(ticks)
    return query("volume", "any", _with_sums(ticks), start + timedelta(milliseconds=360), end - timedelta(milliseconds=120))


@register
def latest_price_one(spark, sf_dir):
    return stats.latest_price(ticks_of(spark, sf_dir), SYMBOL)


# --- windows ------------------------------------------------------------------------


@register
def sma20_candles(spark, sf_dir):
    averaged = moving.sma(candles.ohlcv(ticks_of(spark, sf_dir)), chunk="1 minute")
    return averaged.select("ts_bucket", "symbol", "close_price", F.round("sma20", 8).alias("sma20"))


@register
def sma20_raw(spark, sf_dir):
    averaged = moving.sma_of_mean_price(ticks_of(spark, sf_dir), chunk="2 minutes")
    return averaged.withColumn("sma20", F.round("sma20", 8))


@register
def sma20_minute_candles(spark, sf_dir):
    averaged = moving.sma(layouts_of(ticks_of(spark, sf_dir)).candles_1m, chunk="2 minutes")
    return averaged.withColumn("sma20", F.round("sma20", 8))


@register
def sma20_full(spark, sf_dir):
    averaged = moving.sma(candles.ohlcv(ticks_of(spark, sf_dir)), frames="full")
    return averaged.select("ts_bucket", "symbol", F.round("sma20", 8).alias("sma20"))


@register
def sma20_first100(spark, sf_dir):
    first = moving.first_sma_rows(candles.ohlcv(ticks_of(spark, sf_dir)), SYMBOL)
    return first.withColumn("sma20", F.round("sma20", 8))


@register
def moving_avg_valid(spark, sf_dir):
    """Five-point averages of tick prices; the newest second of each symbol is a short series."""
    ticks = ticks_of(spark, sf_dir)
    seconds = ticks.withColumn("ts_bucket", tumbling("ts", "1 second"))
    averaged = moving.moving_average(
        seconds.select("ts_bucket", "symbol", "seq", "price"), "price", "smooth", keys=["symbol", "ts_bucket"],
        order="seq", chunk=F.expr("seq DIV 16"), width=5, frames="valid",
    )
    return averaged.withColumn("smooth", F.round("smooth", 8))


# --- joins and keyed writes -----------------------------------------------------------


@register
def range_join_count(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    return window_counts(windows_over(ticks, 100, 10, 120), ticks, chunk="1 minute")


@register
def range_join_upside_down(spark, sf_dir):
    """Every third window ends before it starts and holds nothing."""
    ticks = ticks_of(spark, sf_dir)
    windows = windows_over(ticks, 90, 10, 120)
    turned = F.when(F.col("wid") % 3 == 0, F.struct(F.col("t2").alias("t1"), F.col("t1").alias("t2"))).otherwise(F.struct("t1", "t2"))
    return window_counts(windows.select("wid", turned.alias("w")).select("wid", "w.*"), ticks)


@register
def range_join_symbol_avg(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    found = window_stats(windows_over(ticks, 50, 10, 60), ticks, by=["symbol"], chunk="1 minute")
    return found.select("wid", "symbol", "avg_price")


def _checked_ticks(spark, sf_dir):
    """Ticks with NULL where nothing was traded, and eight of the ten symbols."""
    ticks = ticks_of(spark, sf_dir).withColumn("volume", F.nullif("volume", F.lit(0)))
    return ticks, schemas.symbols(spark).where(~F.col("symbol").isin("TSMC", "INTC"))


@register
def fk_rejects(spark, sf_dir):
    return keyed.rejected(*_checked_ticks(spark, sf_dir), ["ts", "symbol", "price", "volume"])


@register
def fk_accepted(spark, sf_dir):
    return keyed.accepted(*_checked_ticks(spark, sf_dir), ["ts", "symbol", "price", "volume"])


@register
def insert_if_absent(spark, sf_dir):
    """Candles of the first half are stored; mean-price candles of all seconds come after."""
    ticks = ticks_of(spark, sf_dir)
    half = ntz(midpoint_of(ticks))
    stored = candles.ohlcv(ticks.where(F.col("ts") < half)).drop("tick_count")
    later = candles.mean_price_candles(ticks, "1 second").select(*stored.columns)
    stored = stored.withColumns({c: F.col(c).cast("double") for c in ("open_price", "close_price")})
    return stored.unionByName(keyed.insert_if_absent(later, stored, ["ts_bucket", "symbol"]))


@register
def insert_first_of_duplicates(spark, sf_dir):
    """Every tick offered as the row of its (second, symbol): the first one stays."""
    offered = ticks_of(spark, sf_dir).withColumn("ts_bucket", tumbling("ts", "1 second"))
    return keyed.insert_if_absent(
        offered, offered.where(F.lit(False)), ["ts_bucket", "symbol"], order=["ts", "seq"]
    )


@register
def upsert_watermarks(spark, sf_dir):
    """A position per symbol from the first half, overwritten by the second half's ticks without volume."""
    ticks = ticks_of(spark, sf_dir).select(
        F.col("symbol").alias("aggregation_interval"), F.col("ts").alias("last_processed_ts"),
        F.col("seq").alias("updated"), "volume",
    )
    half = ntz(midpoint_of(ticks_of(spark, sf_dir)))
    stored = keyed.newest_per_key(
        ticks.where(F.col("last_processed_ts") < half), ["aggregation_interval"], ["updated"]
    )
    updates = ticks.where((F.col("volume") == 0) & (F.col("last_processed_ts") >= half))
    return keyed.upsert(stored, updates, ["aggregation_interval"], ["updated"])


# --- profiles and metrics ---------------------------------------------------------------


@register
def size_share(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = documents.select("source", F.octet_length("text").alias("length"))
    return storage.size_profile(sized, "source", "length")


def _listing(spark, sf_dir):
    """(table, dt, length) of every stored table's day, the lengths being those of its rows as text."""
    layouts = layouts_of(ticks_of(spark, sf_dir))
    by_day = lambda df, name: df.select(F.lit(name).alias("table"), F.to_date("batch").alias("dt"), F.col(df.columns[1]).alias("length"))
    line = lambda df: F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])
    found = by_day(storage.batch_raw_bytes(layouts.raw), "raw_ticks").unionByName(
        by_day(storage.batch_packed_bytes(layouts.packed), "raw_ticks_bucketed"))
    for name, table in (("ohlcv_1s", layouts.candles_1s), ("ohlcv_1m", layouts.candles_1m)):
        table = table.select("ts_bucket", "symbol", "open_price", "high_price", "low_price", "close_price", "volume")
        rows = table.select(F.lit(name).alias("table"), F.to_date("ts_bucket").alias("dt"), (F.octet_length(line(table)) + 1).cast("bigint").alias("length"))
        found = found.unionByName(rows)
    return found


@register
def storage_profile(spark, sf_dir):
    """Sizes of the four tables, their days added up."""
    return storage.size_profile(_listing(spark, sf_dir), "table", "length")


@register
def day_sizes(spark, sf_dir):
    """Sizes of the day partitions of each table."""
    return _listing(spark, sf_dir).groupBy("table", "dt").agg(F.sum("length").alias("bytes"))


@register
def batch_raw_bytes(spark, sf_dir):
    return storage.batch_raw_bytes(ticks_of(spark, sf_dir))


@register
def cumulative_bytes(spark, sf_dir):
    return storage.cumulative_bytes(storage.batch_raw_bytes(ticks_of(spark, sf_dir)))


def _compression(spark, sf_dir):
    """Packed text against row text, per second batch."""
    ticks = ticks_of(spark, sf_dir)
    packed = storage.batch_packed_bytes(buckets.pack(ticks))
    sizes = packed.select(F.lit("packed").alias("table"), "batch", F.col("packed_bytes").alias("length"))
    raw = storage.batch_raw_bytes(ticks).select("batch", "raw_bytes")
    return storage.compression_profile(sizes, raw, "batch", tumbling("batch", "1 minute"))


@register
def compression_profile(spark, sf_dir):
    return _compression(spark, sf_dir).withColumns({name: F.round(name, 8) for name in ("ratio", "saved_percent")})


@register
def compression_totals(spark, sf_dir):
    totals = storage.compression_totals(_compression(spark, sf_dir))
    return totals.withColumns({name: F.round(name, 8) for name in ("mean_ratio", "saved_percent")})


@register
def metric_speedup(spark, sf_dir):
    return metrics.speedup(metrics_of(spark, sf_dir))


@register
def metric_pivot(spark, sf_dir):
    """Users as queries, hours of the day as engines: not every pair was measured."""
    measured = event_feed.read_events(spark, sf_dir).select(
        F.col("user_id").alias("query"),
        F.date_format("ts", "'h'HH").alias("engine"),
        F.col("value").cast("decimal(10,3)").alias("ms"),
    )
    return metrics.query_by_engine(measured, "query", "engine", "ms", [f"h{hour:02d}" for hour in range(24)])


@register
def throughput_p95_clip(spark, sf_dir):
    """Volume traded as rows read, price as seconds taken."""
    measured = event_feed.read_events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("query"),
        F.get_json_object("props", "$.k").cast("int").alias("row_count"),
        F.col("value").cast("decimal(10,3)").cast("double").alias("elapsed"),
    )
    found = metrics.throughput(measured, "query", "id", F.expr("id DIV 512"))
    rounded = {name: F.round(name, 6) for name in ("p95_rate", "mean_rate", "mean_smoothed")}
    return found.withColumns(rounded)


# --- incremental and streaming jobs --------------------------------------------------------


def _advanced(spark, sf_dir, steps):
    """Candles after the given positions were processed one after another."""
    ticks = ticks_of(spark, sf_dir)
    root = shared_dir(spark, "incremental")
    for step in steps(ticks):
        if step == "rewind":
            incremental.rewind(spark, root, midpoint_of(ticks))
        else:
            incremental.advance(spark, ticks, root, until=step)
    return root


@register
def incremental_ohlcv_1s(spark, sf_dir):
    root = _advanced(spark, sf_dir, lambda ticks: [midpoint_of(ticks), None])
    return tables.scan_candles(spark, root, "1 second").drop("dt")


@register
def incremental_ohlcv_1m(spark, sf_dir):
    root = _advanced(spark, sf_dir, lambda ticks: [midpoint_of(ticks), None])
    return tables.scan_or_empty(spark, f"{root}/ohlcv_1m", schemas.CANDLES).drop("dt")


@register
def rewind_idempotent(spark, sf_dir):
    root = _advanced(spark, sf_dir, lambda ticks: [None, "rewind", None])
    return tables.scan_candles(spark, root, "1 second").drop("dt")


@register
def progress_table(spark, sf_dir):
    root = _advanced(spark, sf_dir, lambda ticks: [None, "rewind", None])
    return incremental.read_progress(spark, root).drop("updated_at")


@register
def rebuild_days(spark, sf_dir):
    """All days rebuilt after the ticks of the first one are gone and the others cost a cent more."""
    ticks = ticks_of(spark, sf_dir)
    root = _advanced(spark, sf_dir, lambda _: [None])
    lo, hi = data_extent(ticks)
    left = ticks.where(F.to_date("ts") > F.lit(lo.date())).withColumn("price", (F.col("price") + F.lit("0.01").cast("decimal(10,2)")).cast(schemas.PRICE))
    incremental.rebuild(spark, left, root, lo, hi)
    return tables.scan_candles(spark, root, "1 second").drop("dt")


def _fed(spark, parts, build, run, schema):
    """The table after each part has been all the input of one run, going on from the last one's checkpoint."""
    root = shared_dir(spark, "stream")
    for part in parts:
        part.write.mode("append").parquet(f"{root}/arrivals")
        run(build(jobs.stream_ticks(spark, f"{root}/arrivals")), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return tables.scan_or_empty(spark, f"{root}/table", schema).drop("dt")


@register
def stream_ohlcv_1s(spark, sf_dir):
    return _fed(spark, quarters_of(ticks_of(spark, sf_dir)), jobs.candles, jobs.run_candles, schemas.CANDLES)


@register
def stream_ohlcv_1m(spark, sf_dir):
    return _fed(spark, quarters_of(ticks_of(spark, sf_dir)), lambda s: jobs.rollup(jobs.candles(s)), jobs.run_candles, schemas.CANDLES)


@register
def stream_pack(spark, sf_dir):
    """Ticks dealt out by number, so that every batch holds some of every bucket."""
    ticks = ticks_of(spark, sf_dir)
    parts = [ticks.where(F.col("seq") % 4 == i) for i in range(4)]
    stored = _fed(spark, parts, lambda s: s, jobs.run_packed, schemas.STORED_BUCKETS)
    return bucket_text(buckets.merge_buckets(compact.expand(stored)))


@register
def stream_late_drop(spark, sf_dir):
    """Ticks of one symbol in the first third arrive last, behind the watermark."""
    ticks = ticks_of(spark, sf_dir)
    lo, hi = data_extent(ticks)
    third = [ntz(lo + (hi - lo) * i // 3) for i in (1, 2)]
    late = (F.col("symbol") == "TSLA") & (F.col("ts") < third[0])
    parts = [
        ticks.where((F.col("ts") < third[0]) & ~late),
        ticks.where((F.col("ts") >= third[0]) & (F.col("ts") < third[1])),
        ticks.where(F.col("ts") >= third[1]),
        ticks.where(late),
    ]
    return _fed(spark, parts, jobs.candles, jobs.run_candles, schemas.CANDLES)
