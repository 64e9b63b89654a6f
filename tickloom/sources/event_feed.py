"""Ticks, windows and metrics derived from an ``events`` table.

``events`` rows are spread at four ticks per 120 ms from a start that lies two
minutes before midnight, so that the feed has ties and crosses a day.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions.timecols import ntz

FEED_START = "2024-04-11 23:58:00"

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def _market_columns() -> list:
    names = F.array(*[F.lit(row[0]) for row in schemas.SYMBOL_ROWS])
    return [
        F.element_at(names, F.expr("CAST(user_id % 10 AS INT) + 1")).alias("symbol"),
        F.col("value").cast(schemas.PRICE).alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("volume"),
    ]


def dense_ticks(events: DataFrame) -> DataFrame:
    """The feed at about 33 ticks per second. Works on a stream as well."""
    spread = F.expr("(event_id DIV 4) * 120")
    return events.select(
        F.col("event_id").alias("seq"),
        F.timestamp_add("MILLISECOND", spread, ntz(FEED_START)).alias("ts"),
        *_market_columns(),
    )


def sparse_ticks(events: DataFrame) -> DataFrame:
    """The same trades at the events' own times, about a month."""
    return events.select(F.col("event_id").alias("seq"), "ts", *_market_columns())


def metrics(events: DataFrame) -> DataFrame:
    """Latency measurements: (id, query, variant, ms, recorded_at)."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("query"),
        F.when(F.col("user_id") % 2 == 0, "naive").otherwise("opt").alias("variant"),
        F.col("value").cast("decimal(10,3)").alias("ms"),
        F.col("ts").alias("recorded_at"),
    )
