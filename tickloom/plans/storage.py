"""Size of tables on disk and the effect of compression."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.sizes import pretty_size, share_percent
from tickloom.functions.timecols import tumbling
from tickloom.operators.buckets import pack
from tickloom.operators.moving import running_total, running_totals
from tickloom.sources.listing import list_files
from tickloom.sources.tables import write_buckets, write_ticks

# Codecs that every Spark build can write.
CODECS = ("uncompressed", "lz4_raw", "snappy", "zstd")


def size_profile(sizes: DataFrame, group: str, size: str) -> DataFrame:
    """Bytes per group, readable size and share of the total, largest first."""
    totals = sizes.groupBy(group).agg(F.sum(size).cast("bigint").alias("bytes"))
    whole = sizes.agg(F.sum(size)).scalar()
    return totals.select(
        group, pretty_size(F.col("bytes")).alias("size"), "bytes", share_percent("bytes", whole).alias("share_percent")
    ).orderBy(F.desc("bytes"), group)


def storage_profile(spark: SparkSession, root: str) -> DataFrame:
    """Size of every table under ``root``, its day partitions added up."""
    return size_profile(list_files(spark, root), "table", "length")


def batch_raw_bytes(ticks: DataFrame, resolution: str = "1 second") -> DataFrame:
    """Bytes of each batch as tab-separated text, line ends included."""
    line = F.concat_ws("\t", "symbol", F.col("price").cast("string"), F.col("volume").cast("string"), F.col("ts").cast("string"))
    rows = ticks.select(tumbling("ts", resolution).alias("batch"), (F.octet_length(line) + 1).alias("_bytes"))
    return rows.groupBy("batch").agg(F.sum("_bytes").alias("raw_bytes"), F.count(F.lit(1)).alias("tick_count"))


def batch_packed_bytes(buckets: DataFrame, resolution: str = "1 second") -> DataFrame:
    """Bytes of each batch as text of its packed rows, arrays joined by commas, line ends included."""
    joined = [F.array_join(F.transform(name, lambda x: x.cast(kind).cast("string")), ",")
              for name, kind in (("prices", "decimal(10,2)"), ("volumes", "int"), ("offsets_ms", "int"))]
    line = F.concat_ws("\t", F.col("bucket_ts").cast("string"), "symbol", *joined)
    rows = buckets.select(tumbling("bucket_ts", resolution).alias("batch"), (F.octet_length(line) + 1).alias("_bytes"))
    return rows.groupBy("batch").agg(F.sum("_bytes").alias("packed_bytes"))


def cumulative_bytes(batches: DataFrame) -> DataFrame:
    """Running total of batch bytes in batch order; chunks are days."""
    return running_total(
        batches, "raw_bytes", "cumulative_bytes", keys=[], order="batch", chunk=tumbling("batch", "1 day")
    )


def write_codecs(ticks: DataFrame, root: str, codecs: tuple[str, ...] = CODECS) -> None:
    """Write ticks as rows and as arrays with every codec, a table each."""
    packed = pack(ticks)
    for codec in codecs:
        write_ticks(ticks, f"{root}/ticks-{codec}", codec=codec)
        write_buckets(packed, f"{root}/buckets-{codec}", codec=codec)


def compression_profile(sizes: DataFrame, raw: DataFrame, per: str = "dt", chunk: Column | None = None) -> DataFrame:
    """Ratio and saving of each table and batch against text, with running totals.

    ``sizes`` is (table, ``per``, length) and ``raw`` is (``per``, raw_bytes).
    Totals run along ``per``, a day as text or a time, in chunks.
    """
    stored = sizes.groupBy("table", per).agg(F.sum("length").cast("bigint").alias("stored_bytes"))
    joined = stored.join(raw, per)
    ratio = F.col("raw_bytes") / F.greatest("stored_bytes", F.lit(1))
    saved = (1 - F.col("stored_bytes") / F.col("raw_bytes")) * 100
    measured = joined.withColumns({"ratio": ratio, "saved_percent": saved})
    along = F.substring(per, 1, 4) if chunk is None else chunk
    return running_totals(measured, {"raw_bytes": "cumulative_raw", "stored_bytes": "cumulative_stored"},
                          keys=["table"], order=per, chunk=along)


def compression_totals(profile: DataFrame) -> DataFrame:
    """Total bytes, overall saving and mean ratio of each table."""
    totals = profile.groupBy("table").agg(
        F.sum("raw_bytes").alias("raw_bytes"), F.sum("stored_bytes").alias("stored_bytes"), F.avg("ratio").alias("mean_ratio")
    )
    return totals.withColumn("saved_percent", (1 - F.col("stored_bytes") / F.col("raw_bytes")) * 100)
