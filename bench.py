"""Headline timings on one machine.

Reads the tables under $BENCH_SF_DIR, prepares the stored layouts once, then
runs every query warm, several times, and prints the medians as one JSON line.
``value`` is the sum of the headline queries, jobs that write included; the
rest are comparisons. The ticks are the feed of the events table, repeated on
five days, half a million at sf0.1.
"""

import functools
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from tickloom.catalog.inputs import layouts_of, metrics_of, minutes_of, period_of, ticks_of, windows_over
from tickloom.catalog.queries import QUERIES
from tickloom.operators import buckets, candles, keyed, metrics, ranges, stats
from tickloom.operators.kpis import kpis
from tickloom.operators.moving import sma
from tickloom.operators.range_join import window_counts, window_stats
from tickloom.plans.layouts import Layouts, query
from tickloom.plans.storage import CODECS, write_codecs
from tickloom.session import build_session
from tickloom.sources import listing, tables, text

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
DAYS = 5

SYMBOL = "AAPL"

# The named queries of the two suites, as (name, layouts compared).
SUITE = [
    ("time_range", ("raw", "packed")),
    ("ohlc_scan", ("raw", "candles")),
    ("moving_average", ("raw", "candles")),
    ("volume", ("raw", "packed", "candles")),
    ("latest_price", ("raw", "candles")),
    ("volatility", ("raw", "candles")),
    ("vwap", ("raw", "packed")),
    ("minute_rollup", ("raw", "packed")),
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def big_ticks(spark):
    """Daily trades out of lineitem; its keys give no order, so for order-free aggregates."""
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    return lines.select(
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("symbol"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(10,2)").alias("price"),
        F.col("l_quantity").cast("int").alias("volume"),
    )


def days_of_ticks(spark):
    """The feed on ``DAYS`` days in a row, numbered through."""
    feed = ticks_of(spark, SF_DIR)
    count = feed.count()
    days = [feed.select((F.col("seq") + i * count).alias("seq"), F.timestamp_add("DAY", F.lit(i), F.col("ts")).alias("ts"),
                        "symbol", "price", "volume") for i in range(DAYS)]
    return functools.reduce(lambda a, b: a.unionByName(b), days)


def stored_layouts(spark, root: str) -> Layouts:
    made = layouts_of(days_of_ticks(spark))
    tables.write_ticks(made.raw, f"{root}/ticks")
    tables.write_buckets(made.packed, f"{root}/buckets")
    tables.write_candles(made.candles_1s, f"{root}/ohlcv_1s")
    tables.write_candles(made.candles_1m, f"{root}/ohlcv_1m")
    made.raw.write.parquet(f"{root}/flat")
    made.raw.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(f"{root}/by-day")
    text.write_tsv(made.raw, f"{root}/tsv")
    return Layouts(
        tables.scan_ticks(spark, f"{root}/ticks"),
        tables.scan_buckets(spark, f"{root}/buckets"),
        tables.scan_candles(spark, root, "1 second"),
        tables.scan_candles(spark, root, "1 minute"),
    )


def plain_window_counts(windows, ticks):
    inside = F.col("ts").between(F.col("t1"), F.col("t2"))
    return windows.join(ticks, inside, "left").groupBy("wid").agg(F.count("ts").alias("tick_count"))


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    root = tempfile.mkdtemp(prefix="bench-")
    layouts = stored_layouts(spark, root)
    ticks = layouts.raw
    start, end = period_of(ticks)
    first_minute, last_minute = minutes_of(ticks)
    windows = windows_over(ticks, 100, 10, 120).cache()
    short_windows = windows_over(ticks, 50, 10, 60).cache()
    windows.count(), short_windows.count()

    headline, compared = {}, {}
    for name, forms in SUITE:
        for form in forms:
            period = (first_minute, last_minute) if form == "candles" else (start, end)
            headline[f"{name}_{form}"] = lambda n=name, f=form, p=period: run(query(n, f, layouts, *p, SYMBOL))
            compared[f"{name}_{form}_all_symbols"] = lambda n=name, f=form, p=period: run(query(n, f, layouts, *p))

    headline |= {
        "ohlcv_1s": lambda: run(candles.ohlcv(ticks)),
        "ohlcv_1m_rollup": lambda: run(candles.rollup(layouts.candles_1s)),
        "ohlcv_1s_from_buckets": lambda: run(buckets.ohlcv_from_buckets(layouts.packed)),
        "mean_price_candles_1m": lambda: run(candles.mean_price_candles(ticks, "1 minute")),
        "pack": lambda: run(buckets.pack(ticks)),
        "unpack": lambda: run(buckets.unpack(layouts.packed)),
        "sma20_1s": lambda: run(sma(layouts.candles_1s)),
        "kpis": lambda: run(kpis(layouts.candles_1s)),
        "range_count": lambda: run(stats.row_count(ranges.in_range(ticks, start, end))),
        "symbol_avg_range": lambda: run(stats.mean_price(ranges.in_range(ticks, start, end))),
        "range_join_100_windows": lambda: run(window_counts(windows, ticks)),
        "range_join_50_windows_by_symbol": lambda: run(window_stats(short_windows, ticks, by=["symbol"])),
        "load_tsv": lambda: run(text.load_tsv(spark, f"{root}/tsv")),
        "merge_buckets": lambda: run(buckets.merge_buckets(layouts.packed.drop("dt"))),
        "insert_if_absent": lambda: run(keyed.insert_if_absent(layouts.candles_1s, layouts.candles_1m, ["ts_bucket", "symbol"])),
        "newest_per_key": lambda: run(keyed.newest_per_key(ticks, ["symbol"], ["ts", "seq"])),
        "percentile": lambda: run(metrics.percentile(metrics_of(spark, SF_DIR).withColumn("ms", F.col("ms").cast("double")), "query", "ms", 0.95)),
        "lineitem_daily_candles": lambda: run(candles.mean_price_candles(big_ticks(spark), "1 day")),
    }
    compared |= {
        "ohlcv_1s_struct_key": lambda: run(candles.ohlcv(ticks, key="struct")),
        "ohlcv_1s_long_key": lambda: run(candles.ohlcv(ticks, key="long")),
        "range_join_100_windows_plain": lambda: run(plain_window_counts(windows, ticks)),
        "range_count_flat": lambda: run(stats.row_count(ranges.in_range(spark.read.parquet(f"{root}/flat"), start, end))),
        "range_count_by_day": lambda: run(
            stats.row_count(ranges.in_range(spark.read.parquet(f"{root}/by-day"), start, end))
        ),
    }
    slow = {name: lambda key=key: run(QUERIES[key](spark, SF_DIR)) for name, key in (
        ("incremental_1s", "incremental_ohlcv_1s"), ("stream_1s", "stream_ohlcv_1s"), ("rebuild", "rebuild_days"))}

    medians = {}
    for name, job in {**headline, **compared, **slow}.items():
        job()
        seconds = []
        for _ in range(2 if name in slow else RUNS):
            begun = time.perf_counter()
            job()
            seconds.append(time.perf_counter() - begun)
        medians[name] = round(statistics.median(seconds), 4)

    sizes = f"{root}/codecs"
    write_codecs(ticks.drop("dt"), sizes, CODECS)
    stored = {row.table: row.bytes for row in listing.list_files(spark, sizes).groupBy("table").agg(
        F.sum("length").alias("bytes")
    ).collect()}
    speedups = {
        f"{name}_{form}": round(medians[f"{name}_raw"] / max(medians[f"{name}_{form}"], 1e-6), 2)
        for name, forms in SUITE for form in forms if form != "raw"
    }
    print(json.dumps({
        "metric": "sum of median warm query times",
        "value": round(sum(medians[name] for name in {**headline, **slow}), 4),
        "unit": "sec",
        "queries": medians,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "headline": sorted({**headline, **slow}),
        "speedup_over_raw": speedups,
        "bytes_on_disk": stored,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
