"""Streaming candles, minute rollup and packing.

Watermarks need a zoned timestamp, so ticks get an ``event_time``, their time
taken as UTC whatever the session zone, and results turn back to zone-less
times in the sink. Late ticks, older than the watermark, are dropped; windows come out
once, when the watermark has passed their end.

Packing keeps no state: every batch appends the packed rows of its own ticks,
and readers merge the rows of a bucket.
"""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tickloom import schemas
from tickloom.functions.timecols import epoch_micros, first_last_key, from_epoch_micros
from tickloom.operators.buckets import PART_SIZE, merge_buckets, pack
from tickloom.operators.keyed import append_by_key
from tickloom.sources import compact
from tickloom.sources.tables import compact_day, scan_buckets, with_day, write_buckets, write_by_day, write_candles


# Observed of every batch: ticks that came in, and ticks of the candles that went out.
SEEN, KEPT = "ticks_seen", "ticks_kept"
WAIT_S = 60  # for the progress of a batch that has ended


def stream_ticks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Ticks arriving as Parquet files in a folder, oldest file first."""
    reader = spark.readStream.schema(schemas.TICKS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _watermarked(ticks: DataFrame, delay: str) -> DataFrame:
    return ticks.withColumn("event_time", F.timestamp_micros(epoch_micros("ts"))).withWatermark("event_time", delay)


def candles(ticks: DataFrame, delay: str = "0 seconds", resolution: str = "1 second", key: str = "wide") -> DataFrame:
    """Candles of a tick stream, with their event-time window as ``w``."""
    ticks = ticks.observe(SEEN, F.count(F.lit(1)).alias("ticks"))
    keyed = _watermarked(ticks, delay).withColumn("_at", first_last_key("ts", "seq", key))
    return keyed.groupBy(F.window("event_time", resolution).alias("w"), "symbol").agg(
        F.min_by("price", "_at").alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.max_by("price", "_at").alias("close_price"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("tick_count"),
    )


def rollup(finer: DataFrame, resolution: str = "1 minute") -> DataFrame:
    """Coarser candles of a candle stream: a second window over the first."""
    timed = finer.withColumn("_at", F.col("w.start"))
    return timed.groupBy(F.window(F.window_time("w"), resolution).alias("coarse"), "symbol").agg(
        F.min_by("open_price", "_at").alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"),
        F.max_by("close_price", "_at").alias("close_price"),
        F.sum("volume").alias("volume"),
        F.sum("tick_count").alias("tick_count"),
    ).withColumnRenamed("coarse", "w")


def _window_start(alias: str) -> Column:
    return from_epoch_micros(F.unix_micros("w.start")).alias(alias)


def run_candles(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append finished candles to a day-partitioned table, first write winning.

    ``trigger`` defaults to all available input, then stop.
    """
    columns = [field.name for field in schemas.CANDLES if field.name != "ts_bucket"]
    stream = stream.observe(KEPT, F.coalesce(F.sum("tick_count"), F.lit(0)).alias("ticks"))

    def rows_of(batch: DataFrame) -> DataFrame:
        return batch.select(_window_start("ts_bucket"), *columns)

    return _start(stream, rows_of, path, "ts_bucket", ["ts_bucket", "symbol"], "zstd", checkpoint, trigger)


def run_packed(ticks: DataFrame, path: str, checkpoint: str, part_size: int = PART_SIZE, **trigger) -> StreamingQuery:
    """Append the packed rows of each batch of a tick stream; late ticks are kept.

    A bucket that several batches touch has several rows. ``compact_packed``
    makes them one.
    """
    keys = ["bucket_ts", "symbol", "part", "first_us", "first_seq"]
    return _start(ticks, lambda batch: compact.compact(pack(batch, part_size=part_size)), path, "bucket_ts", keys, "lz4_raw",
                  checkpoint, trigger, compact.WRITER_OPTIONS)


def _start(stream: DataFrame, rows_of: Callable[[DataFrame], DataFrame], path: str, time: str, keys: list[str],
           codec: str, checkpoint: str, trigger: dict, options: dict[str, str] | None = None) -> StreamingQuery:
    # Only the first batch of a run can be one that was written before: a failure
    # ends the query, and a restart begins with the batch that was not committed.
    first = [True]

    def sink(batch: DataFrame, _: int) -> None:
        # The period and the write both read the batch: compute it once.
        rows = rows_of(batch).persist()
        try:
            if first[0]:
                period = rows.agg(F.min(time), F.max(time)).first()
                if period[0] is not None:
                    append_by_key(batch.sparkSession, rows, path, time, keys, tuple(period), codec, options)
            else:
                write_by_day(rows, path, time, ["symbol", time], codec=codec, increment=True, options=options)
            first[0] = False
        finally:
            rows.unpersist()

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(sink).start()


def compact_packed(spark: SparkSession, path: str, day: str) -> None:
    """Merge the packed rows of a day: one row per bucket and part, few files."""
    rows = scan_buckets(spark, path).where(F.col("dt") == F.lit(day).cast("date")).drop("dt")
    compact_day(merge_buckets(rows), path, write_buckets, codec="lz4_raw")


def compact_candles(spark: SparkSession, path: str, day: str) -> None:
    """Write the candles of a day again as few files."""
    rows = spark.read.schema(with_day(schemas.CANDLES)).parquet(path).where(F.col("dt") == F.lit(day).cast("date"))
    compact_day(rows.drop("dt"), path, write_candles)


class LateTicks(StreamingQueryListener):
    """Counts the ticks that candle streams drop as late, in input rows, over all batches and restarts.

    Every batch reports the ticks it read and those of the candles it wrote.
    What was read, is not written and is not held by the query's state either
    was dropped. A batch that runs again after a failure replaces its own
    counts. Listens to the candle queries of the session it was made for, so
    make it before they start:

        late = LateTicks(spark)
        query = run_candles(candles(stream), path, checkpoint)
        query.awaitTermination()
        late.count(query, checkpoint)
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._done, self._last = spark, {}, {}
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = [(progress.observedMetrics.get(name) or {"ticks": 0})["ticks"] for name in (SEEN, KEPT)]
        self._add(str(progress.id), progress.batchId, *found)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _add(self, query: str, batch: int, seen: int, kept: int) -> None:
        before = self._last.get(query)
        if before and before[0] != batch:
            done = self._done.get(query, (0, 0))
            self._done[query] = (done[0] + before[1], done[1] + before[2])
        # the same number again: an idle trigger reports no rows, a batch that ran again all of them
        if before and before[0] == batch and not seen:
            seen, kept = before[1], max(kept, before[2])
        self._last[query] = (batch, seen, kept)

    def totals(self, query: StreamingQuery) -> tuple[int, int]:
        """(ticks read, ticks written as candles) up to the query's last batch."""
        begun, last = time.monotonic(), query.lastProgress
        while last and self._last.get(str(query.id), (-1,))[0] < last["batchId"]:
            if time.monotonic() - begun > WAIT_S:
                raise TimeoutError(f"no progress of batch {last['batchId']}")
            time.sleep(0.02)
        done, last = self._done.get(str(query.id), (0, 0)), self._last.get(str(query.id), (0, 0, 0))
        return done[0] + last[1], done[1] + last[2]

    def count(self, query: StreamingQuery, checkpoint: str) -> int:
        """Ticks dropped so far, exactly, while no batch runs."""
        seen, kept = self.totals(query)
        return seen - kept - held_ticks(self._spark, checkpoint)


def held_ticks(spark: SparkSession, checkpoint: str) -> int:
    """Ticks of candles that the state of a candle stream still holds open."""
    total = 0
    operators = spark.read.format("state-metadata").load(checkpoint).select("operatorId").distinct().collect()
    for (operator,) in operators:
        state = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
        # the tick count is the last aggregate of every level
        fields = [T.StructField(f"_{i}", field.dataType) for i, field in enumerate(state.schema["value"].dataType)]
        last = F.col("value").cast(T.StructType(fields)).getField(fields[-1].name)
        total += state.agg(F.coalesce(F.sum(last), F.lit(0)).cast("bigint")).first()[0]
    return total


def late_groups(query: StreamingQuery) -> int:
    """Partially aggregated groups dropped as late (not input rows).

    Counts the batches whose progress Spark still keeps, by default the last 100.
    """
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
