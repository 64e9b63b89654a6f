"""The named queries, each answered from raw ticks, packed rows or candles.

Spark does not rewrite a raw query onto a rollup, so the layout is an argument.
``any`` reads each part of a range from the coarsest table that fits it, with
the result of raw ticks; see ``tickloom.plans.anyrange``.
Layouts do not always agree, by design: volume, VWAP, latest price and
high/low do on whole buckets, volatility (ticks or closes) and moving average
(mean price or close) do not.
"""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.timecols import resolution_micros
from tickloom.operators import buckets, moving, stats
from tickloom.operators.candles import ohlcv, rollup, tick_statistics
from tickloom.operators.ranges import in_range
from tickloom.plans.anyrange import range_candle


@dataclass(frozen=True)
class Layouts:
    """The tables of one market; a query needs only the one it reads."""

    raw: DataFrame | None = None
    packed: DataFrame | None = None
    candles_1s: DataFrame | None = None
    candles_1m: DataFrame | None = None


def query(name: str, layout: str, tables: Layouts, start: datetime, end: datetime,
          symbol: str | None = None) -> DataFrame:
    """Run a named query on a layout, for one symbol or per symbol.

    Latest price and moving average look at the whole history and ignore the
    range.
    """
    try:
        build = QUERIES[name, layout]
    except KeyError:
        known = sorted(layout for known, layout in QUERIES if known == name)
        raise ValueError(f"{name!r} has no {layout!r} form; it has {known}") from None
    return build(tables, start, end, symbol)


# View name of each table, for parameterised SQL.
VIEWS = {"raw_ticks": "raw", "raw_ticks_bucketed": "packed", "ohlcv_1s": "candles_1s", "ohlcv_1m": "candles_1m"}


def register_views(tables: Layouts) -> None:
    """Make the tables known to SQL under their usual names.

    Queries then run as ``spark.sql(text, args={"symbol": ..., "start": ...})``,
    with a filter on ``dt`` where day folders are to be pruned.
    """
    for view, attribute in VIEWS.items():
        frame = getattr(tables, attribute)
        if frame is not None:
            frame.createOrReplaceTempView(view)


def candles_at(tables: Layouts, resolution: str, key: str = "wide") -> DataFrame:
    """Candles of any resolution, rolled up from the coarsest table that fits.

    Stored one-minute candles serve whole minutes, stored one-second candles
    whole seconds. Without those, ticks go through one-second candles.
    """
    width = resolution_micros(resolution)
    for stored, unit in ((tables.candles_1m, "1 minute"), (tables.candles_1s, "1 second")):
        if stored is not None and width % resolution_micros(unit) == 0:
            return rollup(stored, resolution)
    if width > resolution_micros("1 second") and width % resolution_micros("1 second") == 0:
        return rollup(ohlcv(tables.raw, "1 second", key), resolution)
    return ohlcv(tables.raw, resolution, key)


def _raw(tables, start, end, symbol):
    return in_range(tables.raw, start, end, symbol)


def _packed(tables, start, end, symbol):
    return in_range(tables.packed, start, end, symbol, time="bucket_ts")


def _minutes(tables, start, end, symbol):
    return in_range(tables.candles_1m, start, end, symbol, time="ts_bucket")


OHLC = ["open_price", "high_price", "low_price", "close_price"]


def _tick_statistic(name, tables, start, end, symbol):
    per = ["symbol"] if name == "avg_price" else stats.per_symbol(symbol)
    return tick_statistics(_minutes(tables, start, end, symbol), per).select(*per, name)


def _all(df, symbol):
    return df if symbol is None else df.where(F.col("symbol") == symbol)


QUERIES = {
    ("time_range", "raw"): lambda t, a, b, s: _raw(t, a, b, s),
    ("time_range", "packed"): lambda t, a, b, s: buckets.bucket_range(t.packed, a, b, s),
    ("ohlc_scan", "raw"): lambda t, a, b, s: stats.minute_scan(_raw(t, a, b, s), s),
    ("ohlc_scan", "candles"): lambda t, a, b, s: _minutes(t, a, b, s),
    ("moving_average", "raw"): lambda t, a, b, s: moving.sma_of_mean_price(_all(t.raw, s)),
    ("moving_average", "candles"): lambda t, a, b, s: moving.sma(_all(t.candles_1m, s), chunk="30 days"),
    ("volume", "raw"): lambda t, a, b, s: stats.volume(_raw(t, a, b, s), s),
    ("volume", "packed"): lambda t, a, b, s: buckets.bucket_volume(_packed(t, a, b, s), stats.per_symbol(s)),
    # ticks' own statistics out of candles that carry exact sums, for whole minutes
    ("vwap", "candles"): lambda t, a, b, s: _tick_statistic("vwap", t, a, b, s),
    ("mean_price", "raw"): lambda t, a, b, s: stats.mean_price(_raw(t, a, b, s)),
    ("mean_price", "candles"): lambda t, a, b, s: _tick_statistic("avg_price", t, a, b, s),
    ("tick_volatility", "raw"): lambda t, a, b, s: stats.volatility(_raw(t, a, b, s), "price", s),
    ("tick_volatility", "candles"): lambda t, a, b, s: _tick_statistic("volatility", t, a, b, s),
    # any range, the tables chosen by its parts
    ("volume", "any"): lambda t, a, b, s: range_candle(t, a, b, s).select("symbol", "total_volume", "tick_count"),
    ("ohlc_range", "any"): lambda t, a, b, s: range_candle(t, a, b, s).select("symbol", *OHLC),
    ("vwap", "any"): lambda t, a, b, s: range_candle(t, a, b, s).select("symbol", "vwap"),
    ("mean_price", "any"): lambda t, a, b, s: range_candle(t, a, b, s).select("symbol", "avg_price"),
    ("tick_volatility", "any"): lambda t, a, b, s: range_candle(t, a, b, s).select("symbol", "volatility"),
    ("volume", "candles"): lambda t, a, b, s: stats.candle_volume(_minutes(t, a, b, s), s),
    ("latest_price", "raw"): lambda t, a, b, s: stats.latest_price(t.raw, s),
    ("latest_price", "candles"): lambda t, a, b, s: stats.latest_close(t.candles_1s, s),
    ("volatility", "raw"): lambda t, a, b, s: stats.volatility(_raw(t, a, b, s), "price", s),
    ("volatility", "candles"): lambda t, a, b, s: stats.volatility(_minutes(t, a, b, s), "close_price", s),
    ("vwap", "raw"): lambda t, a, b, s: stats.vwap(_raw(t, a, b, s), s),
    ("vwap", "packed"): lambda t, a, b, s: buckets.bucket_vwap(_packed(t, a, b, s), stats.per_symbol(s)),
    ("minute_rollup", "raw"): lambda t, a, b, s: stats.volume_by(_raw(t, a, b, s), "1 minute", s),
    ("minute_rollup", "packed"): lambda t, a, b, s: buckets.bucket_volume_by(
        _packed(t, a, b, s), "1 minute", stats.per_symbol(s)
    ),
}
