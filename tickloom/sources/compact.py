"""The packed layout as it is stored: small numbers instead of wide keys and repeated values.

A row of ``schemas.BUCKETS`` holds the same facts twice: the first and last
tick are in the arrays and in the candle, tie keys repeat time and number. Here
every fact is stored once, as a difference where one is smaller:

* the first tick's price, time and number, and how far the last tick is off;
* of the ticks between only, how far price, time and number are off the first,
  and the volumes of all but the last, which the row's volume tells;
* the high above and the low below the first and last price, and what the
  notional is off the volume at the middle of these two.

So a row of one tick has empty arrays, and one of two a volume. All of it is
undone by plain expressions without a sum along the array, and columns that a
query does not use are not read. Differences that INT or BIGINT cannot hold go
to columns of their own, which are NULL elsewhere.

Prices are whole cents here, as they are after any merge.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import exact
from tickloom.functions.timecols import epoch_micros, micros_of_key, wide_key

INT_MAX = (1 << 31) - 1
LONG_MAX = (1 << 63) - 1

# Rising numbers and differences that seldom repeat are smaller as packed deltas than by a dictionary.
WITHOUT_DICTIONARY = (
    "bucket_ts", "open_cents", "close_step", "notional_rest", "first_seq", "price_steps.list.element", "wide_price_steps.list.element",
    "wide_seq_steps.list.element",
)
WRITER_OPTIONS = {"parquet.writer.version": "PARQUET_2_0"} | {
    f"parquet.enable.dictionary#{column}": "false" for column in WITHOUT_DICTIONARY}


def _middle(opened: Column, closed: Column) -> Column:
    return F.shiftright(opened + closed, 1)


def _between(array: Column, change) -> Column:
    """``change`` of all elements but the first and the last."""
    return F.transform(F.slice(array, F.lit(2), F.greatest(F.size(array) - 2, F.lit(0))), change)


def _fits(array: Column) -> Column:
    return F.coalesce((F.array_min(array) >= -INT_MAX) & (F.array_max(array) <= INT_MAX), F.lit(True))


def _ints(array: Column) -> Column:
    """The array as INT, declared to be there in every row and without NULLs: Parquet then keeps fewer levels of it."""
    empty = F.slice(F.array(F.lit(0)), 1, 0)
    return F.coalesce(F.transform(array, lambda x: F.coalesce(x.cast("int"), F.lit(0))), empty)


def _int_or_wide(steps: str) -> tuple[Column, Column]:
    """The steps as INT, empty where some are too wide, and the steps that are."""
    fits = _fits(F.col(steps))
    return _ints(F.when(fits, F.col(steps))), F.when(~fits, F.col(steps))


def compact(buckets: DataFrame) -> DataFrame:
    """Packed rows in their stored form; further columns are kept."""
    others = [name for name in buckets.columns if name not in schemas.BUCKETS.names]
    opened, closed = exact.cents("open_price"), exact.cents("close_price")
    low, high = exact.cents("low_price"), exact.cents("high_price")
    first_seq, last_seq = F.element_at("seqs", 1), F.element_at("seqs", -1)
    first_ms = F.element_at("offsets_ms", 1)

    rest = (F.col("notional_cents") - (_middle(opened, closed).cast("decimal(18,0)") * F.col("volume_sum").cast("decimal(19,0)"))).cast("decimal(38,0)")
    narrow = F.abs(rest) <= F.lit(LONG_MAX).cast("decimal(38,0)")
    stepped = buckets.select(
        *schemas.BUCKETS.names, *others,
        _between(F.col("prices"), lambda p: exact.float_cents(p) - opened).alias("_prices"),
        _between(F.col("seqs"), lambda s: s - first_seq).alias("_seqs"),
        rest.alias("_rest"), (micros_of_key(F.col("first_at"), first_seq) - epoch_micros("bucket_ts")).alias("_first"),
        (micros_of_key(F.col("last_at"), last_seq) - epoch_micros("bucket_ts")).alias("_last"),
    )
    prices, wide_prices = _int_or_wide("_prices")
    seqs, wide_seqs = _int_or_wide("_seqs")
    return stepped.select(
        "bucket_ts", "symbol", "part", F.col("tick_count").cast("int").alias("tick_count"), "volume_sum",
        opened.alias("open_cents"), (closed - opened).alias("close_step"),
        (high - F.greatest(opened, closed)).alias("above"), (F.least(opened, closed) - low).alias("below"),
        F.when(narrow, F.col("_rest").cast("bigint")).otherwise(F.lit(0)).alias("notional_rest"),
        F.when(~narrow, F.col("_rest")).alias("wide_notional_rest"),
        F.col("_first").alias("first_us"), (F.col("_last") - F.col("_first")).alias("us_span"),
        first_seq.alias("first_seq"), (last_seq - first_seq).alias("seq_span"),
        prices.alias("price_steps"), _ints(_between(F.col("offsets_ms"), lambda o: o - first_ms)).alias("offset_steps"),
        seqs.alias("seq_steps"), _ints(F.slice("volumes", F.lit(1), F.size("volumes") - 1)).alias("volumes_but_last"), wide_prices.alias("wide_price_steps"), wide_seqs.alias("wide_seq_steps"), *others,
    )


def _with_ends(steps: str, first: Column, last: Column, wide: str | None = None, read=lambda value: value) -> Column:
    """``read`` of first, first + steps, last; the last is left out of a single tick."""
    def all_of(name: str) -> Column:
        inner = F.transform(name, lambda step: read(first + step))
        return F.concat(F.array(read(first)), inner, F.array(read(last)))

    whole = F.when(F.col("tick_count") == 1, F.array(read(first)))
    if wide is not None:
        whole = whole.when(F.col(wide).isNotNull(), all_of(wide))
    return whole.otherwise(all_of(steps))


def expand(stored: DataFrame) -> DataFrame:
    """Stored rows as ``schemas.BUCKETS``; further columns are kept."""
    others = [name for name in stored.columns if name not in schemas.STORED_BUCKETS.names]
    opened, closed = F.col("open_cents"), F.col("open_cents") + F.col("close_step")
    high, low = F.greatest(opened, closed) + F.col("above"), F.least(opened, closed) - F.col("below")
    first_ms = F.floor(F.col("first_us") / 1000).cast("int")
    last_ms = F.floor((F.col("first_us") + F.col("us_span")) / 1000).cast("int")
    notional = _middle(opened, closed).cast("decimal(18,0)") * F.col("volume_sum").cast("decimal(19,0)") + F.coalesce(
        "wide_notional_rest", F.col("notional_rest").cast("decimal(38,0)"))

    def price(cents: Column) -> Column:
        return exact.from_cents(cents).cast(schemas.PRICE)

    def key(micros: Column, seq: Column) -> Column:
        return wide_key(epoch_micros("bucket_ts") + micros, seq).cast("decimal(38,0)")

    others_sum = F.aggregate("volumes_but_last", F.lit(0).cast("bigint"), lambda total, volume: total + volume)
    last_seq = F.col("first_seq") + F.col("seq_span")
    return stored.select(
        "bucket_ts", "symbol", "part",
        _with_ends("price_steps", opened, closed, "wide_price_steps", lambda cents: (cents / F.lit(100.0)).cast("float")).alias("prices"),
        F.concat("volumes_but_last", F.array((F.col("volume_sum") - others_sum).cast("int"))).alias("volumes"),
        _with_ends("offset_steps", first_ms, last_ms).alias("offsets_ms"),
        _with_ends("seq_steps", F.col("first_seq"), last_seq, "wide_seq_steps").alias("seqs"),
        F.col("tick_count").cast("bigint").alias("tick_count"), "volume_sum", notional.cast("decimal(38,0)").alias("notional_cents"),
        price(opened).alias("open_price"), price(high).alias("high_price"), price(low).alias("low_price"), price(closed).alias("close_price"),
        key(F.col("first_us"), F.col("first_seq")).alias("first_at"),
        key(F.col("first_us") + F.col("us_span"), last_seq).alias("last_at"), *others,
    )
