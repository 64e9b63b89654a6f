"""Table schemas and the reference dimension."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PRICE = T.DecimalType(10, 2)

TICKS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("price", PRICE, False),
    T.StructField("volume", T.IntegerType(), False),
])

# Header-less text files hold the four feed columns only, in this order.
TICKS_TSV = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("price", PRICE, False),
    T.StructField("volume", T.IntegerType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
])

BUCKETS = T.StructType([
    T.StructField("bucket_ts", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("part", T.LongType(), False),
    T.StructField("prices", T.ArrayType(T.FloatType(), False), False),
    T.StructField("volumes", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("offsets_ms", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("seqs", T.ArrayType(T.LongType(), False), False),
    # What queries need of a row without its arrays.
    T.StructField("tick_count", T.LongType()),
    T.StructField("volume_sum", T.LongType()),
    T.StructField("notional_cents", T.DecimalType(38, 0)),
    T.StructField("open_price", PRICE),
    T.StructField("high_price", PRICE),
    T.StructField("low_price", PRICE),
    T.StructField("close_price", PRICE),
    T.StructField("first_at", T.DecimalType(38, 0)),
    T.StructField("last_at", T.DecimalType(38, 0)),
])

# The same as stored; see tickloom.sources.compact.
STORED_BUCKETS = T.StructType([
    T.StructField("bucket_ts", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("part", T.LongType(), False),
    T.StructField("tick_count", T.IntegerType(), False),
    T.StructField("volume_sum", T.LongType()),
    T.StructField("open_cents", T.LongType()),
    T.StructField("close_step", T.LongType()),
    T.StructField("above", T.LongType()),
    T.StructField("below", T.LongType()),
    T.StructField("notional_rest", T.LongType()),
    T.StructField("wide_notional_rest", T.DecimalType(38, 0)),
    T.StructField("first_us", T.LongType()),
    T.StructField("us_span", T.LongType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("seq_span", T.LongType()),
    T.StructField("price_steps", T.ArrayType(T.IntegerType(), False)),
    T.StructField("offset_steps", T.ArrayType(T.IntegerType(), False)),
    T.StructField("seq_steps", T.ArrayType(T.IntegerType(), False)),
    T.StructField("volumes_but_last", T.ArrayType(T.IntegerType(), False)),
    T.StructField("wide_price_steps", T.ArrayType(T.LongType(), False)),
    T.StructField("wide_seq_steps", T.ArrayType(T.LongType(), False)),
])

CANDLES = T.StructType([
    T.StructField("ts_bucket", T.TimestampNTZType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("open_price", PRICE),
    T.StructField("high_price", PRICE),
    T.StructField("low_price", PRICE),
    T.StructField("close_price", PRICE),
    T.StructField("volume", T.LongType()),
    T.StructField("tick_count", T.LongType()),
])

# Sums that some candle tables carry, in whole cents: exact, and merged by adding them up.
MOMENTS = T.StructType([
    T.StructField("cents_sum", T.DecimalType(38, 0)),
    T.StructField("square_sum", T.DecimalType(38, 0)),
    T.StructField("notional_cents", T.DecimalType(38, 0)),
])

PROGRESS = T.StructType([
    T.StructField("aggregation_interval", T.StringType(), False),
    T.StructField("last_processed_ts", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampType()),
])

QUERY_METRICS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("query_desc", T.StringType()),
    T.StructField("execution_time_ms", T.DecimalType(10, 3)),
    T.StructField("recorded_at", T.TimestampNTZType()),
])

SYMBOLS = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("sector", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
])

# Table name of each candle resolution.
CANDLE_TABLES = {"1 second": "ohlcv_1s", "1 minute": "ohlcv_1m", "1 hour": "ohlcv_1h", "1 day": "ohlcv_1d"}

# The seeded symbols (symbol, company, sector).
SYMBOL_ROWS = [
    ("GOOGL", "Alphabet Inc.", "Technology"),
    ("META", "Meta Platforms", "Technology"),
    ("TSLA", "Tesla, Inc.", "Consumer Discretionary"),
    ("NVDA", "NVIDIA Corporation", "Technology"),
    ("AMZN", "Amazon.com", "Consumer Discretionary"),
    ("NFLX", "Netflix, Inc.", "Communication Services"),
    ("MSFT", "Microsoft Corp.", "Technology"),
    ("AAPL", "Apple Inc.", "Technology"),
    ("TSMC", "Taiwan Semiconductor", "Technology"),
    ("INTC", "Intel Corporation", "Technology"),
]


def symbols(spark: SparkSession) -> DataFrame:
    """The seeded symbol dimension; new symbols are active by default."""
    return spark.createDataFrame([(*row, True) for row in SYMBOL_ROWS], SYMBOLS)
