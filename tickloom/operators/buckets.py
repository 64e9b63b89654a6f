"""The packed layout: arrays of prices, volumes, offsets and sequence numbers.

A (second, symbol) bucket is one row. Only a bucket of more than ``part_size``
ticks is cut, into runs of ``part_size`` consecutive sequence numbers counted
from its own first one, which bounds each array and spreads a hot bucket over
many tasks; ``part`` is the number of the run, 0 elsewhere. Readers merge the
rows of a bucket, as they must anyway where a bucket was appended in pieces.

A row carries its tick count, volume, notional, candle and first and last tie
key, so volume, VWAP, rollups and candles never read the arrays. Tables of
packed rows store them in the compact form of ``tickloom.sources.compact``.
"""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import exact
from tickloom.functions.arrays import let
from tickloom.functions.timecols import epoch_micros, first_last_key, offset_millis, resolution_micros, tumbling, wide_key
from tickloom.operators.ranges import in_range

PART_SIZE = 1 << 18

KEYS = ["bucket_ts", "symbol", "part"]
ARRAYS = ["prices", "volumes", "offsets_ms", "seqs"]
SUMS = ["tick_count", "volume_sum", "notional_cents", "open_price", "high_price", "low_price", "close_price", "first_at", "last_at"]


def pack(ticks: DataFrame, resolution: str = "1 second", part_size: int = PART_SIZE) -> DataFrame:
    """Gather ticks into arrays per (bucket, symbol), in (ts, seq) order.

    Prices become REAL and times whole milliseconds, so detail below that is
    lost in the arrays; the sums are those of the ticks. ``seq`` must be unique
    within a symbol. Reads the ticks twice: buckets are counted first, from two
    columns, to find those to cut.
    """
    bucketed = ticks.select(tumbling("ts", resolution).alias("bucket_ts"), "ts", "symbol", "price", "volume", "seq")
    bucketed = bucketed.withColumn("_at", first_last_key("ts", "seq"))
    large = bucketed.groupBy("bucket_ts", "symbol").agg(F.count(F.lit(1)).alias("_ticks"), F.min("seq").alias("_from"))
    large = large.where(F.col("_ticks") > part_size).drop("_ticks")
    member = F.struct(
        "ts",
        F.col("seq").alias("seqs"),
        F.col("price").cast("float").alias("prices"),
        F.col("volume").alias("volumes"),
        offset_millis("ts", "bucket_ts", resolution).alias("offsets_ms"),
    )
    part = F.coalesce(F.expr(f"(seq - _from) DIV {part_size}"), F.lit(0).cast("bigint"))
    runs = bucketed.join(large, ["bucket_ts", "symbol"], "left").withColumns({"part": part, "_tick": member})
    gathered = runs.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list("_tick")).alias("_ticks"),
        F.count(F.lit(1)).alias("tick_count"),
        F.sum("volume").cast("bigint").alias("volume_sum"),
        exact.notional(exact.cents("price"), F.col("volume")).alias("notional_cents"),
        F.min_by("price", "_at").cast(schemas.PRICE).alias("open_price"),
        F.max("price").cast(schemas.PRICE).alias("high_price"),
        F.min("price").cast(schemas.PRICE).alias("low_price"),
        F.max_by("price", "_at").cast(schemas.PRICE).alias("close_price"),
        F.min("_at").alias("first_at"),
        F.max("_at").alias("last_at"),
    )
    return gathered.select(*KEYS, *[F.col("_ticks")[name].alias(name) for name in ARRAYS], *SUMS)


def unpack(buckets: DataFrame) -> DataFrame:
    """Packed rows back to ticks, at millisecond and cent precision."""
    carried = ["dt"] if "dt" in buckets.columns else []
    rows = buckets.select(
        "bucket_ts", "symbol", *carried, F.inline(F.arrays_zip("prices", "volumes", "offsets_ms", "seqs"))
    )
    return rows.select(
        F.col("seqs").alias("seq"),
        F.timestamp_add("MILLISECOND", F.col("offsets_ms"), F.col("bucket_ts")).alias("ts"),
        "symbol",
        exact.from_cents(exact.float_cents("prices")).cast(schemas.PRICE).alias("price"),
        F.col("volumes").alias("volume"),
        *carried,
    )


def merge_buckets(buckets: DataFrame, resolution: str = "1 second", part_size: int = PART_SIZE) -> DataFrame:
    """One row per (bucket, symbol, part): combines buckets appended in pieces.

    A tick that is there twice, by symbol, bucket and ``seq``, counts once, so
    appending a bucket again changes nothing. ``resolution`` is that of the
    buckets, or a coarser one to gather them in. A bucket of one row comes back
    as it is; in merged rows times are whole milliseconds and prices cents.

    The rows of a bucket meet in one shuffle and their sorted arrays are merged
    as arrays. Only buckets whose rows hold more than ``part_size`` ticks
    together, which one row may not take, are unpacked and cut anew; a count of
    ticks per bucket, from two columns, tells whether there are any.
    """
    bucketed = buckets.withColumn("_bucket", tumbling("bucket_ts", resolution))
    keys = ["_bucket", "symbol"]
    large = bucketed.groupBy(*keys).agg(F.sum("tick_count").alias("_ticks")).where(F.col("_ticks") > part_size).select(*keys)
    if large.isEmpty():
        return _merged(bucketed)
    cut = bucketed.join(large, keys, "left_semi").drop("_bucket")
    ticks = unpack(cut).withColumn("_bucket", tumbling("ts", resolution))
    parts = pack(ticks.dropDuplicates(["_bucket", "symbol", "seq"]).drop("_bucket"), resolution, part_size)
    return _merged(bucketed.join(large, keys, "left_anti")).unionByName(parts)


def _merged(bucketed: DataFrame) -> DataFrame:
    """One row per ``_bucket`` and symbol, whose ticks fit one row."""
    late = F.expr("CAST(timestampdiff(MILLISECOND, _bucket, bucket_ts) AS INT)")
    own = F.when(F.col("bucket_ts") == F.col("_bucket"), F.col("offsets_ms"))
    offsets = own.otherwise(F.transform("offsets_ms", lambda offset: offset + late))
    piece = F.struct(F.arrays_zip(F.col("seqs"), F.col("offsets_ms"), F.col("prices"), F.col("volumes")).alias("ticks"), *SUMS)
    pieces = bucketed.withColumn("offsets_ms", offsets).withColumn("_piece", piece)
    gathered = pieces.groupBy("_bucket", "symbol").agg(F.collect_list("_piece").alias("_pieces"))
    single = F.col("_pieces")[0]

    def once(ticks):
        # the same number twice: next to each other when sorted by number
        by_seq = F.array_sort(ticks)
        return let(by_seq, lambda all_: F.filter(
            all_, lambda tick, at: (at == 0) | (tick["seqs"] != F.get(all_, at - 1)["seqs"])))

    in_order = F.array_sort(F.transform(once(F.flatten(F.col("_pieces")["ticks"])), lambda tick: F.struct(
        tick["offsets_ms"].alias("offsets_ms"), tick["seqs"].alias("seqs"), tick["prices"].alias("prices"), tick["volumes"].alias("volumes"))))
    ticks = F.when(F.size("_pieces") == 1, F.transform(single["ticks"], lambda tick: F.struct(
        tick["offsets_ms"].alias("offsets_ms"), tick["seqs"].alias("seqs"), tick["prices"].alias("prices"), tick["volumes"].alias("volumes")))).otherwise(in_order)
    rows = gathered.select(
        F.col("_bucket").alias("bucket_ts"), "symbol", F.lit(0).cast("bigint").alias("part"), "_pieces", ticks.alias("_ticks"))
    merged = {name: F.when(F.size("_pieces") == 1, single[name]).otherwise(total) for name, total in _sums_of("_ticks").items()}
    return rows.select(*KEYS, *[F.col("_ticks")[name].alias(name) for name in ARRAYS], *[merged[name].alias(name) for name in SUMS])


def _sums_of(ticks: str) -> dict[str, Column]:
    """A row's sums out of its ticks, which are in order."""
    cents = F.transform(ticks, lambda tick: exact.float_cents(tick["prices"]))
    volumes = F.col(ticks)["volumes"]
    notional = F.aggregate(ticks, F.lit(0).cast("decimal(38,0)"), lambda total, tick: (
        total + exact.float_cents(tick["prices"]).cast("decimal(18,0)") * tick["volumes"]).cast("decimal(38,0)"))
    price = lambda value: exact.from_cents(value).cast(schemas.PRICE)
    first, last = F.element_at(ticks, 1), F.element_at(ticks, -1)
    key = lambda tick: wide_key(epoch_micros("bucket_ts") + tick["offsets_ms"] * F.lit(1000).cast("bigint"), tick["seqs"]).cast("decimal(38,0)")
    return {
        "tick_count": F.size(ticks).cast("bigint"),
        "volume_sum": F.aggregate(volumes, F.lit(0).cast("bigint"), lambda total, volume: total + volume),
        "notional_cents": notional,
        "open_price": price(F.element_at(cents, 1)), "high_price": price(F.array_max(cents)),
        "low_price": price(F.array_min(cents)), "close_price": price(F.element_at(cents, -1)),
        "first_at": key(first), "last_at": key(last),
    }


def bucket_range(buckets: DataFrame, start: datetime, end: datetime, symbol: str | None = None) -> DataFrame:
    """Whole packed rows whose bucket start lies in the closed range.

    A start inside a second leaves that second out, an end inside a second
    keeps all of it. ``bucket_range_exact`` cuts at the ticks.
    """
    return in_range(buckets, start, end, symbol, time="bucket_ts").select("bucket_ts", "symbol", "prices", "volumes")


def bucket_range_exact(buckets: DataFrame, start: datetime, end: datetime, symbol: str | None = None,
                       resolution: str = "1 second") -> DataFrame:
    """Ticks of the closed range, out of the packed layout."""
    width = timedelta(microseconds=resolution_micros(resolution))
    aligned = start - (start - datetime(1970, 1, 1)) % width
    return in_range(unpack(in_range(buckets, aligned, end, symbol, time="bucket_ts")), start, end)


def ohlcv_from_buckets(buckets: DataFrame) -> DataFrame:
    """Candles from the rows' own candles, merging the rows of a bucket."""
    rows = buckets.select(F.col("bucket_ts").alias("ts_bucket"), "symbol", *SUMS)
    return rows.groupBy("ts_bucket", "symbol").agg(
        F.min_by("open_price", "first_at").alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", "last_at").alias("close_price"),
        F.sum("volume_sum").alias("volume"),
        F.sum("tick_count").alias("tick_count"),
    )


def bucket_volume(buckets: DataFrame, per: list[str], pieces: bool = False) -> DataFrame:
    """Volume, buckets and ticks, in one aggregate.

    A bucket cut into several rows is one bucket: its rows of part 0 count. In a
    table where buckets were appended in pieces and not merged yet,
    ``pieces=True`` counts a bucket once whatever its rows, at the price of
    another shuffle; volume and ticks are then those of all pieces.
    """
    ticks = F.coalesce(F.sum("tick_count"), F.lit(0)).alias("tick_count")
    if not pieces:
        return buckets.groupBy(*per).agg(F.sum("volume_sum").alias("total_volume"), F.count_if(F.col("part") == 0).alias("bucket_count"), ticks)
    rows = buckets.select("bucket_ts", "symbol", "volume_sum", "tick_count")
    whole = rows.groupBy("bucket_ts", "symbol").agg(F.sum("volume_sum").alias("volume_sum"), F.sum("tick_count").alias("tick_count"))
    return whole.groupBy(*per).agg(F.sum("volume_sum").alias("total_volume"), F.count(F.lit(1)).alias("bucket_count"), ticks)


def bucket_vwap(buckets: DataFrame, per: list[str]) -> DataFrame:
    """Volume-weighted average price; NULL where no volume traded."""
    total = exact.from_cents(F.sum("notional_cents"))
    return buckets.groupBy(*per).agg(exact.ratio(total, F.sum("volume_sum")).alias("vwap"))


def bucket_volume_by(buckets: DataFrame, resolution: str, per: list[str]) -> DataFrame:
    """Volume per time bucket, ordered by time."""
    rows = buckets.select(tumbling("bucket_ts", resolution).alias("ts_bucket"), "symbol", "volume_sum")
    return rows.groupBy("ts_bucket", *per).agg(F.sum("volume_sum").alias("volume")).orderBy("ts_bucket", *per)
