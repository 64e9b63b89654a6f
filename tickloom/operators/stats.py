"""Statistics over a time range, of one symbol or of all.

Every function takes a frame already cut to its range and a ``symbol``. With a
symbol the result is one row, also on empty input (NULL sums, zero counts).
With ``symbol=None`` it is one row per symbol.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import exact
from tickloom.functions.timecols import first_last_key, tumbling
from tickloom.operators.ranges import of_symbol


def per_symbol(symbol: str | None) -> list[str]:
    """Grouping columns: none for a single symbol."""
    return [] if symbol is not None else ["symbol"]


def _cut(df: DataFrame, symbol: str | None) -> DataFrame:
    return df if symbol is None else of_symbol(df, symbol)


def minute_scan(ticks: DataFrame, symbol: str | None = None, resolution: str = "1 minute") -> DataFrame:
    """Lowest and highest price and volume per time bucket."""
    rows = _cut(ticks, symbol).select(tumbling("ts", resolution).alias("ts_bucket"), "symbol", "price", "volume")
    return rows.groupBy("ts_bucket", *per_symbol(symbol)).agg(
        F.min("price").alias("low_price"), F.max("price").alias("high_price"), F.sum("volume").alias("volume")
    )


def volume(ticks: DataFrame, symbol: str | None = None) -> DataFrame:
    """Total volume and tick count of raw ticks."""
    return _cut(ticks, symbol).groupBy(*per_symbol(symbol)).agg(
        F.sum("volume").alias("total_volume"), F.count(F.lit(1)).alias("tick_count")
    )


def candle_volume(candles: DataFrame, symbol: str | None = None) -> DataFrame:
    """Total volume of candles; equals that of the ticks for whole buckets only."""
    return _cut(candles, symbol).groupBy(*per_symbol(symbol)).agg(F.sum("volume").alias("total_volume"))


def vwap(ticks: DataFrame, symbol: str | None = None) -> DataFrame:
    """Volume-weighted average price; NULL where no volume traded."""
    return _cut(ticks, symbol).groupBy(*per_symbol(symbol)).agg(exact.vwap(ticks, "price", "volume").alias("vwap"))


def volume_by(ticks: DataFrame, resolution: str = "1 minute", symbol: str | None = None) -> DataFrame:
    """Volume per time bucket, ordered by time."""
    rows = _cut(ticks, symbol).select(tumbling("ts", resolution).alias("ts_bucket"), "symbol", "volume")
    keys = ["ts_bucket", *per_symbol(symbol)]
    return rows.groupBy(*keys).agg(F.sum("volume").alias("volume")).orderBy(*keys)


def volatility(df: DataFrame, value: str, symbol: str | None = None) -> DataFrame:
    """Sample standard deviation of tick prices or candle closes; NULL for one row."""
    return _cut(df, symbol).groupBy(*per_symbol(symbol)).agg(
        F.stddev_samp(F.col(value).cast("double")).alias("volatility")
    )


def mean_price(ticks: DataFrame) -> DataFrame:
    """Mean price per symbol."""
    return ticks.groupBy("symbol").agg(exact.mean(ticks, "price").alias("avg_price"))


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def extent(df: DataFrame, time: str = "ts") -> DataFrame:
    """First and last time and the seconds between them; NULLs when empty."""
    span = F.timestamp_diff("MICROSECOND", F.min(time), F.max(time)) / F.lit(1e6)
    return df.agg(F.min(time).alias("data_start"), F.max(time).alias("data_end"), span.alias("span_seconds"))


def high_water(df: DataFrame, time: str = "ts") -> DataFrame:
    """Newest time seen; NULL when empty."""
    return df.agg(F.max(time).alias("high_water"))


def latest_price(ticks: DataFrame, symbol: str | None = None) -> DataFrame:
    """Price of the newest tick, ties going to the highest arrival number.

    One symbol is a top-1, all symbols are one pass with a hash aggregate.
    """
    if symbol is not None:
        return _cut(ticks, symbol).orderBy(F.desc("ts"), F.desc("seq")).limit(1).select("symbol", "ts", "price")
    keyed = ticks.select("symbol", "ts", "price", first_last_key("ts", "seq").alias("_at"))
    return keyed.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("price", "_at").alias("price"))


def latest_close(candles: DataFrame, symbol: str | None = None) -> DataFrame:
    """Close of the newest candle."""
    if symbol is not None:
        newest = _cut(candles, symbol).orderBy(F.desc("ts_bucket")).limit(1)
        return newest.select("symbol", "ts_bucket", "close_price")
    return candles.groupBy("symbol").agg(
        F.max("ts_bucket").alias("ts_bucket"), F.max_by("close_price", "ts_bucket").alias("close_price")
    )
