"""Moving averages and running totals over long, skewed series.

A window partitioned by symbol alone sorts the whole history of a symbol in
one task. Here a series is cut into chunks of time that are processed apart.
Only the first rows of a chunk need rows of an earlier chunk, and those are
among the last ``width - 1`` rows of the chunks before. So only chunk heads and
tails, a small fraction of the rows, go on, and all other rows get their value
inside their chunk. Heads and tails are a series again, in which every head
finds the rows before it; they are cut into chunks of chunks, and so on, until
a window per series is left with few rows. The result is the same as with one
window per series.
"""

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import exact
from tickloom.functions.timecols import UNIT_MICROS, epoch_micros, floor_div, resolution_micros, tumbling

CHUNKS = 1024  # chunks that make one of the next level
LONGEST = 1000 * UNIT_MICROS["day"]  # time chunks as long as this are few in any series


def _frame_columns(df: DataFrame, value: str, frame) -> DataFrame:
    return df.withColumns({
        "_sum": F.sum(value).over(frame),
        "_seen": F.count(value).over(frame),
        "_rows": F.count(F.lit(1)).over(frame),
    })


def _with_edges(df: DataFrame, keys: list[str], order: str, edge: int) -> DataFrame:
    """Whether a row is among the first or last ``edge`` ones of its group."""
    in_order = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({"_head": F.row_number().over(in_order) <= edge, "_tail": F.lead(F.lit(1), edge).over(in_order).isNull()})


def time_chunks(time: str, chunk: str) -> list[Column]:
    """Chunks of a time column, chunks of ``CHUNKS`` chunks, and so on up to ``LONGEST``."""
    widths = [resolution_micros(chunk)]
    while widths[-1] < LONGEST:
        widths.append(widths[-1] * CHUNKS)
    return [floor_div(epoch_micros(time), width) for width in widths]


def number_chunks(number: str, size: int, levels: int = 2) -> list[Column]:
    """Chunks of ``size`` consecutive numbers, then of ``CHUNKS`` times as many, and so on."""
    return [F.expr(f"{number} DIV {size * CHUNKS ** level}") for level in range(levels)]


def moving_average(df: DataFrame, value: str, out: str, *, keys: list[str], order: str, chunk: Column | list[Column],
                   width: int = 20, frames: str = "partial") -> DataFrame:
    """Average of ``value`` over the current row and the ``width - 1`` before it.

    ``chunk`` must rise with ``order`` and bound the rows per (keys, chunk); a
    list of chunks, each made up of whole chunks of the one before, also bounds
    the chunks of a series that meet in one task (``time_chunks``,
    ``number_chunks``). ``order`` must be unique within ``keys``. Frames are
    summed row by row in order, so the result does not depend on where chunks
    are cut.

    ``frames`` decides on the first ``width - 1`` rows of a series:

    * ``partial`` averages the rows there are;
    * ``full`` gives NULL unless ``width`` non-NULL values are in the frame;
    * ``valid`` leaves those rows out, except that a series with fewer than
      ``width`` rows comes back unchanged.
    """
    edge = width - 1
    chunks = [chunk] if isinstance(chunk, Column) else chunk
    names = [f"_chunk{level}" for level in range(len(chunks))]
    rows = df.withColumns({**dict(zip(names, chunks, strict=True)), "_open": F.lit(True)})
    settled = []
    for name in names:
        # an open row still misses its frame; the others are there for the frames of open ones
        rows = _frame_columns(rows, value, Window.partitionBy(*keys, name).orderBy(order).rowsBetween(-edge, 0))
        rows = _with_edges(rows, [*keys, name], order, edge)
        settled.append(rows.where("_open AND NOT _head"))
        rows = rows.where("_head OR _tail").withColumn("_open", F.expr("_open AND _head"))

    series = Window.partitionBy(*keys)
    rows = _frame_columns(rows, value, series.orderBy(order).rowsBetween(-edge, 0))
    # A series with fewer rows than the width consists of heads only.
    rows = rows.withColumn("_short", F.count(F.lit(1)).over(series) < width).where("_open")
    merged = functools.reduce(lambda a, b: a.unionByName(b), [part.withColumn("_short", F.lit(False)) for part in settled] + [rows])

    average = F.col("_sum").cast("double") / F.nullif(F.col("_seen"), F.lit(0))
    if frames == "full":
        average = F.when(F.col("_seen") == width, average)
    elif frames == "valid":
        merged = merged.where(F.col("_short") | (F.col("_rows") == width))
        average = F.when(F.col("_short"), F.col(value).cast("double")).otherwise(average)
    elif frames != "partial":
        raise ValueError(f"unknown frames {frames!r}")
    return merged.select(*df.columns, average.alias(out))


def running_total(df: DataFrame, value: str, out: str, *, keys: list[str], order: str, chunk: Column) -> DataFrame:
    """Cumulative sum of ``value`` along ``order``, NULLs counting as nothing."""
    return running_totals(df, {value: out}, keys=keys, order=order, chunk=chunk)


def running_totals(df: DataFrame, values: dict[str, str], *, keys: list[str], order: str, chunk: Column) -> DataFrame:
    """Cumulative sums along ``order``, named by ``values``; NULLs count as nothing.

    Chunk totals are accumulated first (one row per chunk), then added to the
    running sum inside each chunk.
    """
    chunked = df.withColumn("_chunk", chunk)
    by_chunk = [*keys, "_chunk"]
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(*by_chunk).agg(*[F.sum(value).alias(f"_total_{out}") for value, out in values.items()])
    offsets = totals.select(*by_chunk, *[
        F.coalesce(F.sum(f"_total_{out}").over(before), F.lit(0)).alias(f"_offset_{out}") for out in values.values()])
    inside = Window.partitionBy(*by_chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumns({f"_local_{out}": F.sum(value).over(inside) for value, out in values.items()})
    return local.join(offsets, by_chunk).select(*df.columns, *[
        (F.col(f"_offset_{out}") + F.coalesce(f"_local_{out}", F.lit(0))).alias(out) for out in values.values()])


def sma(candles: DataFrame, width: int = 20, frames: str = "partial", chunk: str = "1 day",
        value: str = "close_price") -> DataFrame:
    """Simple moving average of candle closes per symbol.

    A day holds at most 86,400 one-second candles of a symbol. Use a longer
    chunk for coarser candles.
    """
    return moving_average(
        candles, value, f"sma{width}", keys=["symbol"], order="ts_bucket",
        chunk=time_chunks("ts_bucket", chunk), width=width, frames=frames,
    )


def sma_of_mean_price(ticks: DataFrame, width: int = 20, resolution: str = "1 minute",
                      chunk: str = "30 days") -> DataFrame:
    """Moving average of the mean tick price per bucket, which stands in for the close."""
    rows = ticks.select(tumbling("ts", resolution).alias("ts_bucket"), "symbol", "price")
    means = rows.groupBy("ts_bucket", "symbol").agg(exact.mean(rows, "price").alias("mean_price"))
    return sma(means, width, "partial", chunk, value="mean_price")


def first_sma_rows(candles: DataFrame, symbol: str, rows: int = 100, width: int = 20) -> DataFrame:
    """The first rows of a symbol's moving average, by time.

    Frames only look back, so the top-k runs first and the window sees just
    those rows.
    """
    first = candles.where(F.col("symbol") == symbol).orderBy("ts_bucket").limit(rows)
    frame = Window.partitionBy("symbol").orderBy("ts_bucket").rowsBetween(1 - width, 0)
    averaged = _frame_columns(first, "close_price", frame)
    average = F.col("_sum").cast("double") / F.nullif(F.col("_seen"), F.lit(0))
    return averaged.select("ts_bucket", "symbol", average.alias(f"sma{width}")).orderBy("ts_bucket")
