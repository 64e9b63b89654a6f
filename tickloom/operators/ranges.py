"""Time and symbol filters that prune day partitions."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.timecols import ntz


def in_range(df: DataFrame, start: datetime, end: datetime, symbol: str | None = None,
             time: str = "ts", closed: bool = True) -> DataFrame:
    """Rows of ``[start, end]`` (or ``[start, end)``), optionally of one symbol.

    A filter on the timestamp alone does not prune folders, so a filter on
    ``dt`` is added where the frame has that column.
    """
    hit = F.col(time) >= ntz(start)
    hit &= F.col(time) <= ntz(end) if closed else F.col(time) < ntz(end)
    if symbol is not None:
        hit &= F.col("symbol") == symbol
    if "dt" in df.columns:
        hit &= F.col("dt").between(F.lit(start.date()), F.lit(end.date()))
    return df.where(hit)


def of_symbol(df: DataFrame, symbol: str) -> DataFrame:
    return df.where(F.col("symbol") == symbol)


def bucket_at(df: DataFrame, bucket: datetime, time: str = "bucket_ts") -> DataFrame:
    """Rows of exactly one bucket."""
    hit = F.col(time) == ntz(bucket)
    if "dt" in df.columns:
        hit &= F.col("dt") == F.lit(bucket.date())
    return df.where(hit)


def candle_range(candles: DataFrame, start: datetime, end: datetime, symbol: str | None = None) -> DataFrame:
    """Candles of a closed range, newest first, prices as DOUBLE for analysis."""
    found = in_range(candles, start, end, symbol, time="ts_bucket")
    prices = [F.col(c).cast("double").alias(c) for c in ("open_price", "high_price", "low_price", "close_price")]
    return found.select("ts_bucket", "symbol", *prices, "volume").orderBy(F.desc("ts_bucket"), "symbol")
