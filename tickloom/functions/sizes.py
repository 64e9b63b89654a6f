"""Human-readable sizes and share of a total."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names in rising order, each 1024 times the one before.
UNITS = ["kB", "MB", "GB", "TB", "PB"]


def pretty_size(size: Column) -> Column:
    """Size text in the largest unit that keeps about five digits.

    Plain bytes up to 10 KiB; beyond that the first unit in which the size
    rounds to less than 10240, or PB.
    """
    text = F.when(size < 10 * 1024, F.concat(size.cast("string"), F.lit(" bytes")))
    for step, unit in enumerate(UNITS, start=1):
        halves = F.shiftrightunsigned(size, 10 * step - 1)
        value = F.shiftrightunsigned(halves + 1, 1)
        label = F.concat(value.cast("string"), F.lit(f" {unit}"))
        text = text.otherwise(label) if unit == UNITS[-1] else text.when(halves < 20 * 1024 - 1, label)
    return text


def share_percent(size: str, total: Column) -> Column:
    """Percentage of a total, two decimals."""
    return F.round(F.col(size) * F.lit(100.0) / total, 2)
