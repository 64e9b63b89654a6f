"""Candles from ticks, and coarser candles from finer ones.

All of these group on (bucket, symbol) with hash aggregates that combine
before the shuffle, so a symbol or second that holds most of the rows reaches
the shuffle as one row per map task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import exact
from tickloom.functions.timecols import first_last_key, tumbling


def ohlcv(ticks: DataFrame, resolution: str = "1 second", key: str = "wide", moments: bool = False) -> DataFrame:
    """Open, high, low, close, volume and tick count per (bucket, symbol).

    Open and close are the first and last tick by (ts, seq). For ``key`` see
    ``first_last_key``. ``moments`` adds the exact sums of ``schemas.MOMENTS``,
    out of which mean, VWAP and volatility of the ticks follow at any coarser
    resolution; prices must be decimals of two digits.
    """
    sums = [
        exact.big_sum(exact.cents("price")).cast("decimal(38,0)").alias("cents_sum"),
        exact.square_sum(exact.cents("price")).alias("square_sum"),
        exact.notional(exact.cents("price"), F.col("volume")).alias("notional_cents"),
    ] if moments else []
    keyed = ticks.select(
        tumbling("ts", resolution).alias("ts_bucket"),
        "symbol",
        "price",
        "volume",
        first_last_key("ts", "seq", key).alias("_at"),
    )
    return keyed.groupBy("ts_bucket", "symbol").agg(
        F.min_by("price", "_at").alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.max_by("price", "_at").alias("close_price"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("tick_count"),
        *sums,
    )


def rollup(candles: DataFrame, resolution: str = "1 minute") -> DataFrame:
    """Coarser candles: first open, highest high, lowest low, last close, total volume.

    Exact sums that the candles carry are added up.
    """
    sums = [F.sum(name).cast("decimal(38,0)").alias(name) for name in schemas.MOMENTS.names if name in candles.columns]
    coarse = candles.withColumn("_bucket", tumbling("ts_bucket", resolution))
    merged = coarse.groupBy("_bucket", "symbol").agg(
        F.min_by("open_price", "ts_bucket").alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", "ts_bucket").alias("close_price"),
        F.sum("volume").alias("volume"),
        F.sum("tick_count").alias("tick_count"),
        *sums,
    )
    return merged.withColumnRenamed("_bucket", "ts_bucket")


def mean_price_candles(ticks: DataFrame, resolution: str) -> DataFrame:
    """Direct candles whose open and close are both the mean price.

    Not the same as ``ohlcv``: a cheap approximation that needs no ordering.
    """
    bucketed = ticks.select(tumbling("ts", resolution).alias("ts_bucket"), "symbol", "price", "volume")
    merged = bucketed.groupBy("ts_bucket", "symbol").agg(
        exact.mean(bucketed, "price").alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.sum("volume").alias("volume"),
    )
    return merged.withColumn("close_price", F.col("open_price"))


def second_activity(candles: DataFrame) -> DataFrame:
    """Ticks and active symbols of each candle bucket."""
    return candles.groupBy("ts_bucket").agg(
        F.sum("tick_count").alias("total_ticks"), F.count(F.lit(1)).alias("active_symbols")
    )


def require_sums(candles: DataFrame) -> None:
    """Raises where candles do not carry the exact sums."""
    missing = sorted(set(schemas.MOMENTS.names) - set(candles.columns))
    if missing:
        raise ValueError(f"the candles carry no {', '.join(missing)}: make them with moments=True")


def tick_statistics(candles: DataFrame, per: list[str]) -> DataFrame:
    """Mean price, VWAP and sample volatility of the ticks behind candles that carry exact sums.

    Equal to the statistics of the ticks themselves, which the candles' closes
    do not give.
    """
    require_sums(candles)
    total = lambda name: F.sum(name).cast("decimal(38,0)")
    return candles.groupBy(*per).agg(
        exact.ratio(exact.from_cents(total("cents_sum")), F.sum("tick_count")).alias("avg_price"),
        exact.ratio(exact.from_cents(total("notional_cents")), F.sum("volume")).alias("vwap"),
        exact.deviation(F.sum("tick_count"), total("cents_sum"), total("square_sum")).alias("volatility"),
    )
