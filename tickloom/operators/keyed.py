"""Reference checks and keyed writes: insert if absent, and upsert."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.ranges import in_range
from tickloom.sources.tables import table_exists, with_day, write_by_day


def not_null(df: DataFrame, columns: list[str]) -> Column:
    """Condition: none of the columns is NULL."""
    condition = F.lit(True)
    for name in columns:
        condition &= F.col(name).isNotNull()
    return condition


def accepted(ticks: DataFrame, symbols: DataFrame, required: list[str]) -> DataFrame:
    """Rows with a known symbol and no NULL in the required columns."""
    known = symbols.select("symbol")
    return ticks.where(not_null(ticks, required)).join(known, "symbol", "left_semi")


def rejected(ticks: DataFrame, symbols: DataFrame, required: list[str]) -> DataFrame:
    """The other rows, each with the first reason that applies."""
    known = symbols.select("symbol", F.lit(True).alias("_known")).distinct()
    checked = ticks.join(known, "symbol", "left")
    reason = F.when(~not_null(ticks, required), "null value").when(F.col("_known").isNull(), "unknown symbol")
    return checked.withColumn("reason", reason).where("reason IS NOT NULL").drop("_known")


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest ``order`` of each key."""
    return _first_ranked(df, keys, [F.desc(name) for name in order])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the lowest ``order`` of each key."""
    return _first_ranked(df, keys, [F.asc(name) for name in order])


def _first_ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    # Spark keeps the first row of a key on the map side, before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str],
                     order: list[str] | None = None) -> DataFrame:
    """The rows of ``new`` to append: those whose key is not in ``existing``.

    The first write of a key wins. ``order`` picks the winner among several
    new rows of a key; leave it out when keys in ``new`` are unique already.
    """
    candidates = first_per_key(new, keys, order) if order else new
    return candidates.join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``existing`` with the rows of ``updates`` put in place of their keys.

    The last write wins, also when its values are older. ``existing`` holds
    every key once.
    """
    columns = existing.columns
    offered = updates.select(*dict.fromkeys([*columns, *order])).withColumn("_update", F.lit(1))
    rows = existing.withColumn("_update", F.lit(0)).unionByName(offered, allowMissingColumns=True)
    return newest_per_key(rows, keys, ["_update", *order]).select(*columns)


def append_candles(spark: SparkSession, candles: DataFrame, path: str, period: tuple[datetime, datetime]) -> None:
    """Append the candles whose (ts_bucket, symbol) the table does not have yet.

    ``candles`` must hold each key once and lie within ``period``. Only the day
    partitions of the period are compared. Replaying an increment appends
    nothing. One writer at a time: two at once could both find a key absent.
    """
    append_by_key(spark, candles, path, "ts_bucket", ["ts_bucket", "symbol"], period)


def append_by_key(spark: SparkSession, rows: DataFrame, path: str, time: str, keys: list[str],
                  period: tuple[datetime, datetime], codec: str = "zstd", options: dict[str, str] | None = None) -> None:
    """Append the rows whose key is absent, in day partitions of ``time``."""
    if table_exists(spark, path):
        # With a schema, a folder that a failed first write left empty reads as no rows.
        stored = in_range(spark.read.schema(with_day(rows.schema)).parquet(path), *period, time=time)
        rows = insert_if_absent(rows, stored, keys)
    write_by_day(rows, path, time, ["symbol", time], codec=codec, increment=True, options=options)
