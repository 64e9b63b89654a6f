"""Batch-incremental candles with a progress table.

The store is a folder: ``ohlcv_1s`` and ``ohlcv_1m`` candles and ``progress``,
a small table that is written anew, as another version, at every step. Candles
are written before progress, so a crash in between leads to a replay, and a
replay appends nothing (first write wins). One writer at a time.
"""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions.timecols import ntz
from tickloom.operators.candles import ohlcv, rollup
from tickloom.operators.keyed import append_candles, upsert
from tickloom.operators.ranges import in_range
from tickloom.sources.tables import complete_versions, remove_paths, scan_candles, table_exists, write_by_day

# Older versions of the progress table are removed.
KEEP_VERSIONS = 10  # the default; a reader slower than that many steps needs more


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """The progress table, one row per interval: its newest complete version."""
    versions = complete_versions(spark, f"{root}/progress")
    if not versions:
        return spark.createDataFrame([], schemas.PROGRESS)
    return spark.read.schema(schemas.PROGRESS).parquet(f"{root}/progress/version={versions[-1]}")


def last_processed(spark: SparkSession, root: str, interval: str = "1s") -> datetime | None:
    """End of the processed time of an interval; None before the first step."""
    row = read_progress(spark, root).where(F.col("aggregation_interval") == interval).first()
    return row.last_processed_ts if row else None


def set_progress(spark: SparkSession, root: str, position: datetime, interval: str = "1s",
                 keep: int = KEEP_VERSIONS) -> None:
    """Record a position; the last record counts, even if it lies further back."""
    path = f"{root}/progress"
    versions = complete_versions(spark, path)
    row = spark.range(1).select(
        F.lit(interval).alias("aggregation_interval"),
        ntz(position).alias("last_processed_ts"),
        F.current_timestamp().alias("updated_at"),
    )
    merged = merge_progress(read_progress(spark, root), row)
    # A version that a crash left incomplete is written over.
    version = versions[-1] + 1 if versions else 0
    merged.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    remove_paths(spark, [f"{path}/version={old}" for old in versions[:max(len(versions) + 1 - keep, 0)]])


def rewind(spark: SparkSession, root: str, position: datetime) -> None:
    """Process again from ``position`` on; candles already written stay as they are."""
    set_progress(spark, root, position)


def merge_progress(progress: DataFrame, updates: DataFrame) -> DataFrame:
    """Progress rows with updates applied, last write winning."""
    return upsert(progress, updates, ["aggregation_interval"], ["updated_at"])


def advance(spark: SparkSession, ticks: DataFrame, root: str, until: datetime | None = None,
            key: str = "wide") -> datetime | None:
    """Write the candles of all finished seconds since the last step, in one job.

    A second is finished once a tick of a later second exists, so no candle is
    frozen half full. Seconds without ticks give no candle and are passed over.
    Minutes that end within the step are rolled up from the stored one-second
    candles. ``until`` stops earlier; ticks beyond it are not read. Returns the
    new position.
    """
    position = last_processed(spark, root)
    if position is not None:
        # Days before the position are not read, not even for the high water.
        ticks = in_range(ticks, position, datetime.max.replace(microsecond=0), closed=False)
    if until is not None:
        # One tick at or after ``until`` shows that its second is over.
        later = not in_range(ticks, until, datetime.max.replace(microsecond=0)).limit(1).isEmpty()
        ticks = in_range(ticks, datetime.min, until, closed=False) if later else ticks
    edge = ticks.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if edge.hi is None:
        return position
    end = until.replace(microsecond=0) if until is not None and later else edge.hi.replace(microsecond=0)
    start = position or edge.lo.replace(microsecond=0)
    if start >= end:
        return start

    step = in_range(ticks, start, end, closed=False)
    append_candles(spark, ohlcv(step, "1 second", key), f"{root}/ohlcv_1s", (start, end))

    first_minute, end_minute = start.replace(second=0), end.replace(second=0)
    if first_minute < end_minute and table_exists(spark, f"{root}/ohlcv_1s"):
        seconds = scan_candles(spark, root, "1 second")
        finished = in_range(seconds, first_minute, end_minute, time="ts_bucket", closed=False)
        append_candles(spark, rollup(finished, "1 minute"), f"{root}/ohlcv_1m", (first_minute, end_minute))

    set_progress(spark, root, end)
    return end


def rebuild(spark: SparkSession, ticks: DataFrame, root: str, first_day: datetime, last_day: datetime,
            key: str = "wide") -> None:
    """Replace the candles of every day of a range: the way to correct candles.

    A day whose ticks are gone loses its candles. Only finished seconds and
    minutes are written, as in ``advance``; the days must lie before the
    progress position for that not to matter. Ticks are aggregated once:
    seconds are replaced first, then minutes, rolled up from the stored
    seconds, then empty days are removed; after a crash in between, the same
    call makes all three right.
    """
    first, last = first_day.date(), last_day.date()
    chosen = ticks.where(F.to_date("ts").between(F.lit(first), F.lit(last)))
    if "dt" in ticks.columns:
        chosen = chosen.where(F.col("dt").between(F.lit(first), F.lit(last)))
    position = last_processed(spark, root)
    if position is not None:
        chosen = chosen.where(F.col("ts") < ntz(position))
    days = _replace_days(ohlcv(chosen, "1 second", key), f"{root}/ohlcv_1s")
    every = {first + timedelta(days=i) for i in range((last - first).days + 1)}
    # days that the write above did not touch may still hold old seconds
    stored = scan_candles(spark, root, "1 second").where(F.col("dt").isin(sorted(days)) if days else F.lit(False))
    minutes = rollup(stored, "1 minute")
    if position is not None:
        minutes = minutes.where(F.col("ts_bucket") < ntz(position.replace(second=0)))
    full = {"ohlcv_1s": days, "ohlcv_1m": _replace_days(minutes, f"{root}/ohlcv_1m")}
    for table, written in full.items():
        remove_paths(spark, [f"{root}/{table}/dt={day}" for day in sorted(every - written)])


def _replace_days(candles: DataFrame, path: str) -> set:
    """Write candles in place of the days they have rows of; returns these days, observed while writing."""
    seen = Observation()
    observed = candles.observe(seen, F.collect_set(F.to_date("ts_bucket")).alias("days"))
    write_by_day(observed, path, "ts_bucket", ["symbol", "ts_bucket"], replace_days=True)
    return set(seen.get["days"])
