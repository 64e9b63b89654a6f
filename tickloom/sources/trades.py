"""Cutting a period of trades into ordered slices and per-second batches."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.timecols import tumbling
from tickloom.operators.ranges import in_range


def historic_slice(ticks: DataFrame, start: datetime, minutes: int) -> DataFrame:
    """Trades of all symbols in ``[start, start + minutes)``, in time order.

    ``window_start`` is the one-minute window of each trade, counted from
    ``start``; windows without trades have no rows.
    """
    period = in_range(ticks, start, start + timedelta(minutes=minutes), closed=False)
    window = F.window("ts", "1 minute", startTime=f"{start.second * 1_000_000 + start.microsecond} microseconds")
    return period.withColumn("window_start", window.getField("start")).orderBy("ts", "seq")


def second_batches(ticks: DataFrame) -> DataFrame:
    """One row per event second: tick count and timestamp of the first trade."""
    seconds = ticks.select(tumbling("ts", "1 second").alias("batch_second"), "ts")
    return seconds.groupBy("batch_second").agg(
        F.count(F.lit(1)).alias("total_ticks"), F.min("ts").alias("first_ts")
    )
