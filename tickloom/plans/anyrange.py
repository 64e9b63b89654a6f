"""Statistics of any time range, read from the coarsest tables that fit its parts.

A closed range is cut at full minutes and full seconds. Its middle is read from
one-minute candles, the seconds before and after from one-second candles, and
only the cut seconds at both ends from ticks. The parts are candles all alike,
of disjoint times, and merge into one candle per symbol, whose exact sums give
the same figures as the ticks of the range would. So a caller names a range and
no table.
"""

import functools
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import exact
from tickloom.operators.candles import ohlcv, require_sums
from tickloom.operators.ranges import in_range

EPOCH, INSTANT = datetime(1970, 1, 1), timedelta(microseconds=1)
SECOND, MINUTE = timedelta(seconds=1), timedelta(minutes=1)


def _inner(start: datetime, end: datetime, width: timedelta) -> tuple[datetime, datetime]:
    """The part of ``[start, end)`` that whole buckets make up; empty where its end is not after its start."""
    return start + (EPOCH - start) % width, end - (end - EPOCH) % width


def cover(start: datetime, end: datetime, widths: tuple[timedelta, ...]) -> list[tuple[timedelta | None, datetime, datetime]]:
    """Half-open parts of ``[start, end)``, each with the widest bucket that fits it; None is ticks.

    ``widths`` rise, each a multiple of the one before.
    """
    if start >= end:
        return []
    for width in reversed(widths):
        low, high = _inner(start, end, width)
        if low < high:
            finer = tuple(other for other in widths if other < width)
            return [*cover(start, low, finer), (width, low, high), *cover(high, end, finer)]
    return [(None, start, end)]


def range_parts(tables, start: datetime, end: datetime, symbol: str | None = None, until: datetime | None = None) -> DataFrame:
    """Candles with exact sums that make up the closed range ``[start, end]``.

    ``tables`` is a ``Layouts`` whose candles carry the sums. Candles are taken
    to be complete before ``until``, where that is given, and ticks are read
    from there on.
    """
    stop = end + INSTANT
    sources = {width: frame for width, frame in ((SECOND, tables.candles_1s), (MINUTE, tables.candles_1m)) if frame is not None}
    for frame in sources.values():
        require_sums(frame)
    known = stop if until is None or until >= stop else max(start, until.replace(microsecond=0))
    parts = []
    for width, low, high in [*cover(start, known, tuple(sorted(sources))), *cover(known, stop, ())]:
        if width is None:
            ticks = in_range(tables.raw, low, high, symbol, closed=False)
            # a cut second is one candle, whichever part of it is in the range
            parts.append(ohlcv(ticks, "1 second", moments=True))
        else:
            parts.append(in_range(sources[width], low, high, symbol, time="ts_bucket", closed=False))
    columns = [*schemas.CANDLES.names, *schemas.MOMENTS.names]
    if not parts:
        return ohlcv(tables.raw.where(F.lit(False)), moments=True).select(*columns)
    return functools.reduce(lambda a, b: a.unionByName(b), [part.select(*columns) for part in parts])


def range_candle(tables, start: datetime, end: datetime, symbol: str | None = None, until: datetime | None = None) -> DataFrame:
    """One candle of the closed range per symbol, with mean price, VWAP and volatility of its ticks.

    Symbols without ticks in the range have no row.
    """
    total = lambda name: F.sum(name).cast("decimal(38,0)")
    return range_parts(tables, start, end, symbol, until).groupBy("symbol").agg(
        F.min_by("open_price", "ts_bucket").alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", "ts_bucket").alias("close_price"),
        F.sum("volume").alias("total_volume"),
        F.sum("tick_count").alias("tick_count"),
        exact.ratio(exact.from_cents(total("cents_sum")), F.sum("tick_count")).alias("avg_price"),
        exact.ratio(exact.from_cents(total("notional_cents")), F.sum("volume")).alias("vwap"),
        exact.deviation(F.sum("tick_count"), total("cents_sum"), total("square_sum")).alias("volatility"),
    )
