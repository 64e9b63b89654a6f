"""Statistics of many time windows over one tick table, by running totals.

The total of a window is the running total at its end less that before its
start, so a window costs two lookups whatever its length. Ticks are summed per
time bucket, and per exact time in the buckets that hold an end of a window;
the ends are merged into these sums in time order, and running totals along
them, taken chunk by chunk, are read off at the ends.

Per value of some columns that would take lookups for every value, also where
it does not trade. There a window is cut into aligned cells of 1, 8, 64, ...
buckets and its cut buckets at both ends instead, a few dozen pieces whatever
its length, and the pieces meet the sums of the values that have ticks in them.
So a window costs rows only for values in its result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import exact
from tickloom.functions.timecols import epoch_micros, floor_div, from_epoch_micros, resolution_micros, tumbling
from tickloom.operators.moving import running_totals
from tickloom.operators.ranges import in_range

START, TICKS, END = 0, 1, 2  # order at the same time: starts, ticks, ends
CELLS = 8  # cells of a level that make one of the next
EDGE = -1  # the level of buckets that a window cuts


def window_stats(windows: DataFrame, ticks: DataFrame, by: list[str] | None = None,
                 resolution: str = "1 second", chunk: str = "1 hour") -> DataFrame:
    """Count, price sum and mean price per window, optionally per ``by`` columns.

    ``windows`` is (wid, t1, t2), both ends inclusive; a window with ``t1 >
    t2`` holds nothing. Windows without ticks have no rows. ``chunk`` is the
    time over which totals run in one task; chunk totals are added up after.
    Runs one job over the windows, for the extent to read.
    """
    totals = _totals_by(windows, ticks, by, resolution) if by else _totals(windows, ticks, resolution, chunk)
    totals = totals.where("_n > 0")
    return totals.select(
        "wid", *(by or []), F.col("_n").alias("tick_count"), F.col("_s").alias("price_sum"),
        exact.ratio(F.col("_s"), F.col("_n")).alias("avg_price"),
    )


def window_counts(windows: DataFrame, ticks: DataFrame, resolution: str = "1 second", chunk: str = "1 hour") -> DataFrame:
    """Tick count of every window, zero included."""
    found = _totals(windows, ticks, resolution, chunk).select("wid", "t1", "t2", "_n")
    none = windows.select("wid", "t1", "t2", F.lit(0).cast("bigint").alias("_n"))
    return found.unionByName(none).groupBy("wid", "t1", "t2").agg(F.sum("_n").alias("tick_count"))


def _sums(ticks: DataFrame, cut: DataFrame, by: list[str], resolution: str) -> DataFrame:
    """Ticks and prices summed per bucket, and per exact time in the buckets of ``cut``."""
    bucketed = ticks.withColumn("_bucket", tumbling("ts", resolution)).join(cut.withColumn("_cut", F.lit(True)), "_bucket", "left")
    at = F.when(F.col("_cut"), F.col("ts")).otherwise(F.col("_bucket"))
    return bucketed.withColumn("at", at).groupBy("at", *by).agg(
        F.count(F.lit(1)).alias("_n"), exact.price_sum(ticks, "price").alias("_s"))


def _totals(windows: DataFrame, ticks: DataFrame, resolution: str, chunk: str) -> DataFrame:
    """(wid, t1, t2, _n, _s) of the windows that are not upside down."""
    windows = windows.where("t1 <= t2")
    extent = windows.agg(F.min("t1"), F.max("t2")).first()
    wanted = in_range(ticks, *extent) if extent[0] is not None else ticks.where(F.lit(False))

    end = lambda time, kind, sign: F.struct(
        F.col(time).alias("at"), F.lit(kind).alias("kind"), F.lit(sign).cast("bigint").alias("sign"))
    ends = windows.select("wid", "t1", "t2", F.inline(F.array(end("t1", START, -1), end("t2", END, 1))))
    sums = _sums(wanted, ends.select(tumbling("at", resolution).alias("_bucket")).distinct(), [], resolution)

    place = (epoch_micros("at") * 3 + F.col("kind")).alias("_place")
    marks = ends.select("wid", "t1", "t2", "sign", "at", place)
    steps = sums.withColumn("kind", F.lit(TICKS)).select("at", place, "_n", "_s")
    merged = steps.unionByName(marks, allowMissingColumns=True)
    running = running_totals(merged, {"_n": "_upto_n", "_s": "_upto_s"}, keys=[], order="_place", chunk=tumbling("at", chunk))
    read = running.where(F.col("wid").isNotNull())
    return read.groupBy("wid", "t1", "t2").agg(
        F.sum(F.col("_upto_n") * F.col("sign")).alias("_n"),
        (F.sum(F.when(F.col("sign") > 0, F.col("_upto_s"))) - F.sum(F.when(F.col("sign") < 0, F.col("_upto_s")))).alias("_s"),
    )


def _pieces(windows: DataFrame, width: int, levels: int) -> DataFrame:
    """The windows with their pieces (_level, _cell): aligned cells of ``CELLS ** level`` buckets, and at level EDGE their cut buckets."""
    start, stop, power = epoch_micros("t1"), epoch_micros("t2") + 1, CELLS.bit_length() - 1
    piece = lambda level, cell: F.struct(F.lit(level).alias("_level"), cell.alias("_cell"))
    # whole buckets in the window: from _low up to, not including, _high
    ends = windows.withColumns({"_low": floor_div(start + (width - 1), width), "_high": floor_div(stop, width),
                                "_first": floor_div(start, width), "_start_cut": F.pmod(start, F.lit(width)) != 0,
                                "_stop_cut": F.pmod(stop, F.lit(width)) != 0})

    def inner(level: int) -> tuple[Column, Column]:
        """The cells of a level that lie in the window whole."""
        size = CELLS ** level
        return F.shiftright(F.col("_low") + (size - 1), power * level), F.shiftright("_high", power * level)

    def cells(level: int, low: Column, high: Column) -> Column:
        some = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(some, lambda cell: piece(level, cell))

    cut = F.array_distinct(F.array_compact(F.array(F.when(F.col("_start_cut"), F.col("_first")), F.when(F.col("_stop_cut"), F.col("_high")))))
    found = [F.transform(cut, lambda cell: piece(EDGE, cell))]
    for level in range(levels):
        low, high = inner(level)
        if level < levels - 1:
            upper_low, upper_high = inner(level + 1)
            left, right = F.when(upper_low <= upper_high, upper_low * CELLS).otherwise(high), F.when(upper_low <= upper_high, upper_high * CELLS).otherwise(high)
            found += [cells(level, low, left), cells(level, right, high)]
        else:
            found.append(cells(level, low, high))
    return ends.select(*windows.columns, F.inline(F.concat(*found)))


def _totals_by(windows: DataFrame, ticks: DataFrame, by: list[str], resolution: str) -> DataFrame:
    """(wid, t1, t2, by, _n, _s) of the windows and the values that have ticks in them."""
    width = resolution_micros(resolution)
    windows = windows.where("t1 <= t2").select("wid", "t1", "t2")
    longest = F.max(epoch_micros("t2") - epoch_micros("t1"))
    first, last, longest = windows.agg(F.min("t1"), F.max("t2"), longest).first()
    wanted = in_range(ticks, first, last) if first is not None else ticks.where(F.lit(False))
    levels = 1
    while CELLS ** levels * width < (longest or 0):
        levels += 1

    pieces = _pieces(windows, width, levels)
    cut = pieces.where(F.col("_level") == EDGE).select(from_epoch_micros(F.col("_cell") * width).alias("_bucket")).distinct()
    sums = _sums(wanted, cut, by, resolution).withColumn("_bucket", floor_div(epoch_micros("at"), width))
    place = lambda level, cell, at: F.struct(F.lit(level).alias("_level"), cell.alias("_cell"), at.alias("at"))
    none = F.lit(None).cast("timestamp_ntz")
    power = CELLS.bit_length() - 1
    places = [place(level, F.call_function("shiftright", F.col("_bucket"), F.lit(power * level)), none) for level in range(levels)]
    tree = sums.select(*by, "_n", "_s", F.inline(F.array(place(EDGE, F.col("_bucket"), F.col("at")), *places)))
    tree = tree.groupBy(*by, "_level", "_cell", "at").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    inside = (F.col("_level") != EDGE) | F.col("at").between(F.col("t1"), F.col("t2"))
    met = pieces.join(tree, ["_level", "_cell"]).where(inside)
    return met.groupBy("wid", "t1", "t2", *by).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
