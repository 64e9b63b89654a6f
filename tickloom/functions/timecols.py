"""Time bucketing, literals and the first/last ordering key.

Ticks carry TIMESTAMP_NTZ. ``window`` buckets those with long arithmetic,
whereas ``date_trunc`` converts each value to a zoned timestamp and back, so
buckets are always built with ``window``. Both are aligned to the epoch and
agree for seconds, minutes, hours and days.
"""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}

# A second has 20 bits of microseconds, which leaves 43 for the sequence number.
SEQ_BITS = 43


def resolution_micros(resolution: str) -> int:
    """Microseconds in a resolution such as ``"1 second"`` or ``"5 minutes"``."""
    count, unit = resolution.split()
    return int(count) * UNIT_MICROS[unit.rstrip("s")]


def ntz(value: datetime | str) -> Column:
    """A zone-less timestamp literal.

    A Python datetime turned into a literal directly is a zoned timestamp, and
    comparing it with an NTZ column casts the column and stops pushdown.
    """
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def epoch_micros(ts: str) -> Column:
    """Microseconds of a zone-less timestamp since 1970, in any session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def from_epoch_micros(micros: Column) -> Column:
    """The zone-less timestamp that many microseconds after 1970."""
    return F.timestamp_add("MICROSECOND", micros, ntz("1970-01-01 00:00:00"))


def floor_div(number: Column, by: int) -> Column:
    """A BIGINT divided by a positive number, rounded down."""
    by = F.lit(by).cast("bigint")
    return F.call_function("div", number - F.pmod(number, by), by)


def tumbling(ts: str, resolution: str) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    return F.window(ts, resolution).getField("start")


def wide_key(micros: Column, seq: Column) -> Column:
    """Microseconds above 19 digits of the sequence number, as one decimal."""
    return micros.cast("decimal(38,0)") * F.lit("1E19").cast("decimal(20,0)") + seq


def micros_of_key(key: Column, seq: Column) -> Column:
    """The microseconds of a wide key with that sequence number."""
    whole = (key - seq.cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.call_function("div", whole, F.lit("1E19").cast("decimal(20,0)"))


def first_last_key(ts: str, seq: str, key: str = "wide") -> Column:
    """Ordering of ticks inside one bucket: by time, then by arrival number.

    A struct key would force a sort-based aggregate, so the pair is packed into
    one number:

    * ``wide``, the default, is a 38-digit decimal that takes any time and any ``seq``.
    * ``long`` puts the microsecond of the second above 43 bits of ``seq``: faster,
      for buckets of up to a second. It raises when ``seq`` does not fit.
    * ``struct`` is the plain pair, kept for comparison.
    """
    if key == "long":
        return F.expr(
            f"CASE WHEN {seq} >= 0 AND {seq} < {1 << SEQ_BITS}L "
            f"THEN shiftleft(pmod(unix_micros(CAST({ts} AS TIMESTAMP)), 1000000L), {SEQ_BITS}) + {seq} "
            f"ELSE raise_error('{seq} does not fit 43 bits: use the wide key') END"
        )
    if key == "wide":
        return wide_key(epoch_micros(ts), F.col(seq))
    if key == "struct":
        return F.struct(ts, seq)
    raise ValueError(f"unknown key {key!r}")


def offset_millis(ts: str, bucket: str, resolution: str) -> Column:
    """Whole milliseconds between the bucket start and ``ts``."""
    if UNIT_MICROS["second"] % resolution_micros(resolution) == 0:
        width = resolution_micros(resolution) // 1_000
        return F.expr(f"CAST(pmod(unix_millis(CAST({ts} AS TIMESTAMP)), {width}L) AS INT)")
    return F.expr(f"CAST(timestampdiff(MILLISECOND, {bucket}, {ts}) AS INT)")
