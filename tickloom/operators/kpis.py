"""The indicator block of a dashboard, for all symbols at once."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exact import ratio


def kpis(candles: DataFrame, width: int = 20) -> DataFrame:
    """Latest close, total volume, volatility and current moving average per symbol.

    The moving average is that of the last ``width`` candles, or 0 when these
    are fewer or hold a NULL close. Only a symbol's newest rows are ranked:
    Spark keeps ``width`` per symbol on the map side.
    """
    totals = candles.groupBy("symbol").agg(
        F.max_by("close_price", "ts_bucket").alias("latest_price"),
        F.sum("volume").alias("total_volume"),
        F.stddev_samp(F.col("close_price").cast("double")).alias("volatility"),
    )
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("ts_bucket"))
    newest = candles.select("symbol", "close_price", F.row_number().over(newest_first).alias("_rn"))
    newest = newest.where(F.col("_rn") <= width)
    current = newest.groupBy("symbol").agg(
        F.when(F.count("close_price") == width, ratio(F.sum("close_price"), F.count("close_price"))).alias("_sma")
    )
    joined = totals.join(current, "symbol", "left")
    return joined.select(*totals.columns, F.coalesce("_sma", F.lit(0.0)).alias("current_sma"))
