"""Header-less tab-separated tick files: symbol, price, volume, ts."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom import schemas

# Up to that many splits their starts, 16 bytes each, travel with every task.
BROADCAST_SPLITS = 1_000_000

TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"


def load_tsv(spark: SparkSession, paths: str | list[str], number: bool = True) -> DataFrame:
    """Read tick files; malformed lines fail the job instead of turning NULL.

    The files carry no arrival number. ``number=True`` adds one: 0, 1, 2 in
    line order within and across files, files by path. However the files are
    split, the numbers are the same. They cost a counting pass over the files:
    lines are counted per split, and running totals of these counts, one row per
    split, are where each split starts. Lines find their split's start by a hash
    of its place, in a lookup that goes to the tasks, so no line is shuffled; a
    hash that two splits share would fail the job.
    """
    reader = spark.read.schema(schemas.TICKS_TSV).option("timestampNTZFormat", TS_FORMAT)
    ticks = reader.csv(paths, sep="\t", header=False, mode="FAILFAST")
    if not number:
        return ticks
    placed = ticks.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_nr"),
    )
    splits = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_lines"), F.min("_nr").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")
    starts = splits.select(F.xxhash64("_file", "_block").alias("_split"), shift.alias("_shift")).groupBy("_split").agg(
        F.when(F.count(F.lit(1)) == 1, F.max("_shift")).otherwise(F.raise_error(F.lit("two splits have one hash"))).alias("_shift"))
    # a partition is one split of a large file, or several whole files
    if placed.rdd.getNumPartitions() + len(ticks.inputFiles()) <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    numbered = placed.withColumn("_split", F.xxhash64("_file", "_block")).join(starts, "_split")
    return numbered.select((F.col("_nr") + F.col("_shift")).alias("seq"), "ts", "symbol", "price", "volume")


def clock_time(text: str, fallback: str) -> Column:
    """A clock time such as ``09:30`` or ``09:30:15`` as seconds of the day; ``fallback`` where it is none."""
    parsed = F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.trim(F.col(text))), F.lit(form))
                          for form in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")])
    hours, minutes, *seconds = (int(part) for part in fallback.split(":"))
    default = F.lit(hours * 3600 + minutes * 60 + sum(seconds))
    return F.coalesce(F.hour(parsed) * 3600 + F.minute(parsed) * 60 + F.second(parsed), default)


def clock_label(ts: str) -> Column:
    """The ``HH:MM`` label of a time."""
    return F.date_format(ts, "HH:mm")


def write_tsv(ticks: DataFrame, path: str) -> None:
    """Write the four feed columns as tab-separated text."""
    rows = ticks.select("symbol", "price", "volume", F.col("ts").cast("string"))
    rows.write.csv(path, sep="\t", header=False)
