"""Day-partitioned Parquet tables.

Writers range-partition on (day, symbol, time). A busy day or symbol is then
spread over many files, each covering a narrow symbol and time range, so that
file and row-group statistics prune on both columns. AQE merges small ranges.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas
from tickloom.session import materialize
from tickloom.sources import compact


def with_day(schema: T.StructType) -> T.StructType:
    """The schema with the day partition at its end."""
    return T.StructType([*schema.fields, T.StructField("dt", T.DateType())])


def write_by_day(df: DataFrame, path: str, time: str, order: list[str], codec: str = "zstd",
                 partitions: int | None = None, increment: bool = False, replace_days: bool = False,
                 options: dict[str, str] | None = None) -> None:
    """Append ``df`` under ``path`` with one folder per day of ``time``.

    Each row goes to the day of its own timestamp. ``partitions`` sets how many
    ranges a bulk load is cut into; by default that is the session's number of
    shuffle partitions, of which AQE merges the small ones. ``increment`` is
    for additions to a few days: rows are gathered by day without the sampling
    pass of a range split, and AQE splits a large day. ``replace_days``
    overwrites the days that ``df`` has rows of. ``options`` are the file
    writer's own.
    """
    dated = df.withColumn("dt", F.to_date(time))
    if increment:
        dated = dated.hint("rebalance", "dt")
    elif partitions:
        dated = dated.repartitionByRange(partitions, "dt", *order)
    else:
        dated = dated.repartitionByRange("dt", *order)
    # The leading dt keeps one open writer per task.
    dated = dated.sortWithinPartitions("dt", *order)
    writer = dated.write.mode("append")
    if replace_days:
        writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.options(**(options or {})).option("compression", codec).partitionBy("dt").parquet(path)


def compact_day(rows: DataFrame, path: str, write: Callable[..., None], codec: str = "zstd") -> None:
    """Replace days of a table by ``rows``, which were read from it, as few files.

    ``write`` is the table's own writer. The rows are written to the shared
    folder first, as a job must not overwrite what it reads. One writer at a
    time.
    """
    write(materialize(rows, "compact"), path, codec=codec, replace_days=True)


def write_ticks(ticks: DataFrame, path: str, **options) -> None:
    """Append ticks into daily partitions, sorted by symbol and time."""
    write_by_day(ticks, path, "ts", ["symbol", "ts", "seq"], **options)


def write_buckets(buckets: DataFrame, path: str, codec: str = "lz4_raw", **options) -> None:
    """Append packed rows into daily partitions, in their compact form."""
    write_by_day(compact.compact(buckets), path, "bucket_ts", ["symbol", "bucket_ts"], codec=codec,
                 options=compact.WRITER_OPTIONS, **options)


def write_candles(candles: DataFrame, path: str, **options) -> None:
    """Append candles into daily partitions without any key check."""
    write_by_day(candles, path, "ts_bucket", ["symbol", "ts_bucket"], **options)


def scan_ticks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(with_day(schemas.TICKS)).parquet(path)


def scan_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Packed rows of a table that ``write_buckets`` or a packing stream wrote."""
    return compact.expand(spark.read.schema(with_day(schemas.STORED_BUCKETS)).parquet(path))


def scan_candles(spark: SparkSession, root: str, resolution: str, moments: bool = False) -> DataFrame:
    """The candle table of a resolution, e.g. ``ohlcv_1m`` for ``1 minute``; ``moments`` reads the exact sums written with it."""
    path = f"{root}/{schemas.CANDLE_TABLES[resolution]}"
    fields = [*schemas.CANDLES, *(schemas.MOMENTS if moments else [])]
    return spark.read.schema(with_day(T.StructType(fields))).parquet(path)


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that a job may not have written to yet."""
    if table_exists(spark, path):
        return spark.read.schema(with_day(schema)).parquet(path)
    return spark.createDataFrame([], with_day(schema))


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written to ``path``."""
    files, hadoop_path = _file_system(spark, path)
    return files.exists(hadoop_path)


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``version=N`` folders below ``path`` whose write finished, rising."""
    files, hadoop_path = _file_system(spark, path)
    if not files.exists(hadoop_path):
        return []
    marker = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for status in files.listStatus(hadoop_path):
        name = status.getPath().getName()
        if name.startswith("version=") and files.exists(marker(status.getPath(), "_SUCCESS")):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that the package wrote itself."""
    for path in paths:
        files, hadoop_path = _file_system(spark, path)
        files.delete(hadoop_path, True)
