"""Inputs shared by the registered queries, all derived from ``events``."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.timecols import from_epoch_micros, ntz
from tickloom.operators.buckets import pack
from tickloom.operators.candles import ohlcv, rollup
from tickloom.plans.layouts import Layouts
from tickloom.sources import event_feed

EPOCH = datetime(1970, 1, 1)
GRID = timedelta(seconds=3)  # feed ticks fall on every third full second


def ticks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_feed.dense_ticks(event_feed.read_events(spark, sf_dir))


def sparse_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_feed.sparse_ticks(event_feed.read_events(spark, sf_dir))


def metrics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_feed.metrics(event_feed.read_events(spark, sf_dir))


def layouts_of(ticks: DataFrame) -> Layouts:
    seconds = ohlcv(ticks, "1 second")
    return Layouts(ticks, pack(ticks), seconds, rollup(seconds, "1 minute"))


def data_extent(ticks: DataFrame) -> tuple[datetime, datetime]:
    """First and last tick time. Runs a job that returns one row."""
    row = ticks.agg(F.min("ts"), F.max("ts")).first()
    return row[0], row[1]


def period_of(ticks: DataFrame) -> tuple[datetime, datetime]:
    """The data extent without its first and last eighth, with ends on a tick."""
    lo, hi = data_extent(ticks)
    eighth = (hi - lo) // 8
    return _floor(lo + eighth, GRID), _floor(hi - eighth, GRID)


def minutes_of(ticks: DataFrame) -> tuple[datetime, datetime]:
    """The same period cut to whole minutes, the last one included as a candle."""
    start, end = period_of(ticks)
    minute = timedelta(minutes=1)
    return _floor(start, minute), _floor(end, minute)


def midpoint_of(ticks: DataFrame) -> datetime:
    lo, hi = data_extent(ticks)
    return _floor(lo + (hi - lo) // 2, GRID)


def _floor(value: datetime, step: timedelta) -> datetime:
    return value - (value - EPOCH) % step


def windows_over(ticks: DataFrame, count: int, shortest: int, longest: int) -> DataFrame:
    """``count`` closed windows spread over the data, lengths in seconds.

    Every second one starts on the three-second grid, where ticks fall.
    """
    spark = ticks.sparkSession
    lo, hi = data_extent(ticks)
    lo_us, span_us = (lo - EPOCH) // timedelta(microseconds=1), (hi - lo) // timedelta(microseconds=1)
    start = F.lit(lo_us) + F.expr(f"{span_us}L * id DIV {count}")
    grid = GRID // timedelta(microseconds=1)
    start = F.when(F.col("id") % 2 == 0, start - start % grid).otherwise(start)
    length = (F.lit(shortest) + (F.col("id") * 37) % (longest - shortest + 1)) * 1_000_000
    return spark.range(count).select(
        F.col("id").alias("wid"),
        from_epoch_micros(start).alias("t1"),
        from_epoch_micros(start + length).alias("t2"),
    )


def quarters_of(ticks: DataFrame) -> list[DataFrame]:
    """The ticks in four parts, one after another in time."""
    lo, hi = data_extent(ticks)
    cuts = [ntz(lo + (hi - lo) * i // 4) for i in (1, 2, 3)]
    first, middle = ticks.where(F.col("ts") < cuts[0]), zip(cuts, cuts[1:], strict=False)
    between = [ticks.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in middle]
    return [first, *between, ticks.where(F.col("ts") >= cuts[2])]


def report(df: DataFrame) -> DataFrame:
    """Types that compare the same everywhere: decimals as DOUBLE, dates as text."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def array_text(name: str, decimals: bool = False):
    """An array as comma-separated text, prices with two decimals."""
    kind = "decimal(10,2)" if decimals else "bigint"
    return F.array_join(F.transform(name, lambda x: x.cast(kind).cast("string")), ",").alias(name)


def bucket_text(buckets: DataFrame) -> DataFrame:
    """Packed rows with their arrays as text, without tie keys."""
    names = [n for n in buckets.columns if n in ("volumes", "offsets_ms", "seqs")]
    others = [n for n in buckets.columns if n not in (*names, "prices", "first_at", "last_at")]
    return buckets.select(*others, array_text("prices", decimals=True), *[array_text(n) for n in names])
