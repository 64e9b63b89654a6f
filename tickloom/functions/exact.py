"""Exact aggregates of decimal prices, at the cost of integer ones.

Sums of DOUBLE change in the last digits with the partitioning, and sums of
DECIMAL run on arbitrary-precision numbers. Decimal prices are whole cents, so
cents are summed as BIGINT. A sum is kept as two or four BIGINT halves of the
numbers, which become one wide decimal once per group: no schema value and no
group of up to 10**11 rows overflows, and beyond that ANSI mode raises.

Prices of other types (FLOAT, DOUBLE) are averaged as they are, unrounded.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF = 24  # bits of the lower half of a summed number
SPLIT = 16  # bits of the lower half of a volume
SQUARE_SPLIT = 20  # bits of the lower half of a number that is squared


def price_scale(df: DataFrame, price: str) -> int | None:
    """Digits after the point of a decimal column that fits BIGINT; None for other types."""
    kind = df.schema[price].dataType
    return kind.scale if isinstance(kind, T.DecimalType) and kind.precision <= 18 else None


def cents(price: str, scale: int = 2) -> Column:
    """A decimal of ``scale`` digits as a whole number of its last digit."""
    return F.expr(f"CAST(CAST({price} AS DECIMAL(18,{scale})) * {10 ** scale} AS BIGINT)")


def float_cents(price: str | Column) -> Column:
    """Cents of a REAL price, half a cent going up."""
    return F.floor((F.col(price) if isinstance(price, str) else price).cast("double") * 100 + 0.5)


def wide(number: Column) -> Column:
    return number.cast("decimal(28,0)")


def big_sum(number: Column) -> Column:
    """Sum of a BIGINT as a wide decimal, by two sums that stay far from overflow."""
    low = number.bitwiseAND(F.lit((1 << HALF) - 1))
    return wide(F.sum(F.shiftright(number, HALF))) * F.lit(1 << HALF).cast("decimal(8,0)") + wide(F.sum(low))


def notional(price_cents: Column, volume: Column) -> Column:
    """Sum of ``price_cents * volume`` as a wide decimal; the volume is split, so that no product overflows."""
    volume = volume.cast("bigint")
    high, low = F.shiftright(volume, SPLIT), volume.bitwiseAND(F.lit((1 << SPLIT) - 1))
    return (big_sum(price_cents * high) * F.lit(1 << SPLIT).cast("decimal(6,0)") + big_sum(price_cents * low)).cast("decimal(38,0)")


def square_sum(price_cents: Column) -> Column:
    """Sum of squares as a wide decimal; the number is split, so that no product overflows."""
    high, low = F.shiftright(price_cents, SQUARE_SPLIT), price_cents.bitwiseAND(F.lit((1 << SQUARE_SPLIT) - 1))
    unit = lambda bits: F.lit(1 << bits).cast("decimal(14,0)")
    # (high * 2**s + low)**2
    whole = big_sum(high * high) * unit(2 * SQUARE_SPLIT) + big_sum(high * low) * unit(SQUARE_SPLIT + 1) + big_sum(low * low)
    return whole.cast("decimal(38,0)")


def deviation(count: Column, total: Column, squares: Column, scale: int = 2) -> Column:
    """Sample standard deviation out of a count, a sum and a sum of squares of whole cents; NULL below two.

    Squares are moved to the whole number below the mean before anything is
    rounded, so values far from zero that lie close together lose no digits.
    """
    n, total = count.cast("decimal(17,0)"), total.cast("decimal(27,0)")
    middle = F.floor(total / F.nullif(n, F.lit(0).cast("decimal(17,0)"))).cast("decimal(11,0)")
    rest = (total - n * middle).cast("decimal(18,0)")
    apart = squares - (middle * (total + rest).cast("decimal(26,0)")).cast("decimal(38,0)")
    variance = (apart.cast("double") - rest.cast("double") * rest.cast("double") / count.cast("double")) / (count - 1).cast("double")
    return F.when(count > 1, F.sqrt(F.greatest(variance, F.lit(0.0))) / (10 ** scale))


def from_cents(total: Column, scale: int = 2) -> Column:
    """Whole cents as a decimal of ``scale`` digits."""
    unit = F.lit(f"1E-{scale}").cast(f"decimal({scale + 1},{scale})")
    return total.cast(f"decimal({37 - 2 * scale},0)") * unit


def mean(df: DataFrame, value: str) -> Column:
    """Average as DOUBLE: of decimals the exact sum, rounded once, of other types their plain average."""
    scale = price_scale(df, value)
    if scale is None:
        return F.avg(F.col(value).cast("double"))
    return ratio(from_cents(big_sum(cents(value, scale)), scale), F.count(value))


def price_sum(df: DataFrame, value: str) -> Column:
    """Sum of a price column: exact for decimals, DOUBLE for other types."""
    scale = price_scale(df, value)
    return F.sum(F.col(value).cast("double")) if scale is None else from_cents(big_sum(cents(value, scale)), scale)


def vwap(df: DataFrame, price: str, volume: str) -> Column:
    """``sum(price * volume) / sum(volume)`` as DOUBLE; NULL without volume."""
    scale = price_scale(df, price)
    if scale is None:
        return ratio(F.sum(F.col(price).cast("double") * F.col(volume)), F.sum(volume))
    return ratio(from_cents(notional(cents(price, scale), F.col(volume)), scale), F.sum(volume))


def ratio(total: Column, count: Column) -> Column:
    """``total / count`` as DOUBLE; NULL when the count is zero."""
    return total.cast("double") / F.nullif(count.cast("double"), F.lit(0.0))
