"""DuckDB SQL with the same result as each registered query.

Every query has an entry.
"""

from tickloom import schemas

NAMES = str([row[0] for row in schemas.SYMBOL_ROWS])

# The feed as in tickloom.sources.event_feed, and the parts of its extent.
TICKS = f"""
ticks AS (
  SELECT event_id AS seq,
         TIMESTAMP '2024-04-11 23:58:00' + to_milliseconds((event_id // 4) * 120) AS ts,
         ({NAMES})[(user_id % 10)::INT + 1] AS symbol,
         CAST(value AS DECIMAL(10,2)) AS price,
         (props->>'$.k')::INT AS volume
  FROM events),
bounds AS (
  SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM ticks),
period AS (
  SELECT make_timestamp((lo + span // 8) // 3000000 * 3000000) AS t1,
         make_timestamp((hi - span // 8) // 3000000 * 3000000) AS t2,
         make_timestamp((lo + span // 2) // 3000000 * 3000000) AS mid,
         make_timestamp(lo + span // 3) AS third1,
         make_timestamp(lo + span * 2 // 3) AS third2
  FROM bounds)"""

SPARSE = f"""
sparse AS (
  SELECT event_id AS seq, ts,
         ({NAMES})[(user_id % 10)::INT + 1] AS symbol,
         CAST(value AS DECIMAL(10,2)) AS price,
         (props->>'$.k')::INT AS volume
  FROM events)"""


def _candles(name: str, unit: str, source: str = "ticks") -> str:
    return f"""
{name} AS (
  SELECT date_trunc('{unit}', ts) AS ts_bucket, symbol,
         first(price ORDER BY ts, seq) AS open_price, max(price) AS high_price, min(price) AS low_price,
         last(price ORDER BY ts, seq) AS close_price, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS tick_count
  FROM {source} GROUP BY ALL)"""


C1S = _candles("c1s", "second")

C1M = C1S + """,
c1m AS (
  SELECT date_trunc('minute', ts_bucket) AS ts_bucket, symbol,
         first(open_price ORDER BY ts_bucket) AS open_price, max(high_price) AS high_price,
         min(low_price) AS low_price, last(close_price ORDER BY ts_bucket) AS close_price,
         CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(tick_count) AS BIGINT) AS tick_count
  FROM c1s GROUP BY date_trunc('minute', c1s.ts_bucket), symbol)"""

PACKED_ROWS = """
         string_agg(price::VARCHAR, ',' ORDER BY ts, seq) AS prices,
         string_agg(volume::VARCHAR, ',' ORDER BY ts, seq) AS volumes,
         string_agg(((epoch_us(ts) % 1000000) // 1000)::VARCHAR, ',' ORDER BY ts, seq) AS offsets_ms,
         string_agg(seq::VARCHAR, ',' ORDER BY ts, seq) AS seqs,
         count(*) AS tick_count, CAST(sum(volume) AS BIGINT) AS volume_sum,
         (sum(price * volume) * 100)::DOUBLE AS notional_cents,
         first(price ORDER BY ts, seq)::DOUBLE AS open_price, max(price)::DOUBLE AS high_price,
         min(price)::DOUBLE AS low_price, last(price ORDER BY ts, seq)::DOUBLE AS close_price"""

PACKED = f"""
packed AS (
  SELECT date_trunc('second', ts) AS bucket_ts, symbol, 0::BIGINT AS part, {PACKED_ROWS}
  FROM ticks GROUP BY ALL)"""

# Buckets of more than four ticks are cut into runs of four numbers.
PACKED_IN_FOURS = f"""
runs AS (
  SELECT *, CASE WHEN count(*) OVER w > 4 THEN (seq - min(seq) OVER w) // 4 ELSE 0 END AS part
  FROM (SELECT *, date_trunc('second', ts) AS bucket_ts FROM ticks) WINDOW w AS (PARTITION BY bucket_ts, symbol)),
packed AS (SELECT bucket_ts, symbol, part, {PACKED_ROWS} FROM runs GROUP BY bucket_ts, symbol, part)"""

TICK = "seq, ts, symbol, price::DOUBLE AS price, volume"

OHLC = """ts_bucket, symbol, open_price::DOUBLE AS open_price, high_price::DOUBLE AS high_price,
  low_price::DOUBLE AS low_price, close_price::DOUBLE AS close_price, volume"""

CANDLE = OHLC + ", tick_count"

# Exact sum first, one division last.
MEAN = "sum(price)::DOUBLE / count(price)"


def _with(*parts: str, select: str) -> str:
    return f"WITH {','.join(parts)}\n{select}"


def _ticks(select: str, *more: str) -> str:
    return _with(TICKS, *more, select=select)


def _mean_candles(unit: str) -> str:
    return f"""
SELECT date_trunc('{unit}', ts) AS ts_bucket, symbol, {MEAN} AS open_price, max(price)::DOUBLE AS high_price,
       min(price)::DOUBLE AS low_price, {MEAN} AS close_price, CAST(sum(volume) AS BIGINT) AS volume
FROM ticks GROUP BY date_trunc('{unit}', ts), symbol"""


def _windows(count: int, shortest: int, longest: int) -> str:
    return f"""
starts AS (
  SELECT w.i AS wid, CASE WHEN w.i % 2 = 0 THEN (lo + span * w.i // {count}) // 3000000 * 3000000
                          ELSE lo + span * w.i // {count} END AS start
  FROM range({count}) w(i), bounds),
windows AS (
  SELECT wid, make_timestamp(start) AS t1,
         make_timestamp(start + ({shortest} + (wid * 37) % {longest - shortest + 1}) * 1000000) AS t2
  FROM starts)"""


IN_PERIOD = "FROM ticks, period WHERE ts BETWEEN t1 AND t2"
BUCKET_IN_PERIOD = "FROM ticks, period WHERE date_trunc('second', ts) BETWEEN t1 AND t2"
HALF = "INTERVAL 500 MILLISECOND"
MINUTES = "date_trunc('minute', t1) AND date_trunc('minute', t2)"
CLOSED_SECONDS = "ts_bucket + INTERVAL 1 SECOND <= (SELECT max(ts) FROM ticks)"

SMA = "sum(close_price) OVER w::DOUBLE / count(close_price) OVER w"
FRAME20 = "WINDOW w AS (PARTITION BY symbol ORDER BY ts_bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"

FINISHED = "ts_bucket < (SELECT date_trunc('second', max(ts)) FROM ticks)"

BATCHES = """
batches AS (
  SELECT date_trunc('second', ts) AS batch,
         CAST(sum(strlen(symbol || chr(9) || price::VARCHAR || chr(9) || volume::VARCHAR || chr(9) || ts::VARCHAR) + 1) AS BIGINT)
           AS raw_bytes,
         count(*) AS tick_count
  FROM ticks GROUP BY ALL)"""

PACKED_LINE = "strlen(bucket_ts::VARCHAR || symbol || prices || volumes || offsets_ms) + 5"

LISTING = f"""
listing AS (
  SELECT 'raw_ticks' AS tbl, batch::DATE AS dt, raw_bytes AS length FROM batches
  UNION ALL SELECT 'raw_ticks_bucketed', bucket_ts::DATE, {PACKED_LINE} FROM packed""" + "".join(f"""
  UNION ALL SELECT '{name}', ts_bucket::DATE, strlen(ts_bucket::VARCHAR || symbol || open_price::VARCHAR || high_price::VARCHAR
    || low_price::VARCHAR || close_price::VARCHAR || volume::VARCHAR) + 7 FROM {table}""" for name, table in (("ohlcv_1s", "c1s"), ("ohlcv_1m", "c1m"))) + ")"

COMPRESSED = f"""
compressed AS (
  SELECT batch, raw_bytes, stored_bytes, raw_bytes / greatest(stored_bytes, 1) AS ratio, (1 - stored_bytes / raw_bytes) * 100 AS saved_percent
  FROM batches JOIN (SELECT bucket_ts AS batch, CAST(sum({PACKED_LINE}) AS BIGINT) AS stored_bytes FROM packed GROUP BY bucket_ts) USING (batch))"""

METRICS = """
metrics AS (
  SELECT event_id AS id, event_type AS query, CASE WHEN user_id % 2 = 0 THEN 'naive' ELSE 'opt' END AS variant,
         value::DECIMAL(10,3) AS ms, (props->>'$.k')::INT AS volume
  FROM events)"""

HOURS = [f"h{hour:02d}" for hour in range(24)]

PRETTY = """CASE WHEN bytes < 10240 THEN bytes || ' bytes'
  WHEN bytes // 512 < 20479 THEN (bytes // 512 + 1) // 2 || ' kB'
  WHEN bytes // 524288 < 20479 THEN (bytes // 524288 + 1) // 2 || ' MB'
  WHEN bytes // 536870912 < 20479 THEN (bytes // 536870912 + 1) // 2 || ' GB'
  WHEN bytes // 549755813888 < 20479 THEN (bytes // 549755813888 + 1) // 2 || ' TB'
  ELSE (bytes // 562949953421312 + 1) // 2 || ' PB' END"""

ORACLES: dict[str, str] = {
    # sources, sinks and layout
    "tick_scan": _ticks(f"SELECT {TICK} FROM ticks"),
    "candle_scan": _ticks(
        f"SELECT {CANDLE}, '1s' AS resolution FROM c1s UNION ALL SELECT {CANDLE}, '1m' AS resolution FROM c1m", C1M
    ),
    "load_tsv_roundtrip": _ticks("SELECT symbol, price::DOUBLE AS price, volume, ts FROM ticks"),
    "load_tsv_candles": _ticks(f"SELECT {CANDLE} FROM c1s", C1S),
    "clock_labels": _ticks(
        """SELECT strftime(ts, '%H:%M') AS label,
           CASE WHEN symbol = 'AAPL' THEN 34200 ELSE (hour(ts) * 60 + minute(ts)) * 60 END::INT AS second_of_day, count(*) AS tick_count
           FROM ticks GROUP BY ALL"""
    ),
    "daily_partition_counts": _ticks("SELECT ts::DATE::VARCHAR AS dt, count(*) AS tick_count FROM ticks GROUP BY ALL"),
    "bucket_partition_counts": _ticks(
        """SELECT ts::DATE::VARCHAR AS dt,
           count(DISTINCT (date_trunc('second', ts), symbol)) AS bucket_rows, count(*) AS tick_count
           FROM ticks GROUP BY ts::DATE"""
    ),
    "historic_slice": _ticks(
        f"""SELECT {TICK}, t1 + to_minutes(((epoch_us(ts) - epoch_us(t1)) // 60000000)) AS window_start
            FROM ticks, period
            WHERE ts >= t1 AND ts < t1 + to_minutes((epoch_us(t2) - epoch_us(t1)) // 60000000)"""
    ),
    "second_batches": _ticks(
        """SELECT date_trunc('second', ts) AS batch_second, count(*) AS total_ticks, min(ts) AS first_ts
           FROM ticks GROUP BY ALL"""
    ),
    # filters
    "range_scan": _ticks(f"SELECT {TICK} {IN_PERIOD} AND symbol = 'AAPL'"),
    "half_open_range": _ticks(f"SELECT {TICK} FROM ticks, period WHERE ts >= t1 AND ts < t2"),
    "symbol_scan": _ticks(f"SELECT {TICK} FROM ticks WHERE symbol = 'AAPL'"),
    "time_range_raw": _ticks(f"SELECT {TICK} {IN_PERIOD}"),
    "bucket_lookup": _ticks("SELECT packed.* FROM packed, period WHERE bucket_ts = mid", PACKED),
    "time_range_packed": _ticks(
        "SELECT bucket_ts, symbol, prices, volumes FROM packed, period WHERE bucket_ts BETWEEN t1 AND t2", PACKED
    ),
    "bucket_range_scan": _ticks(
        f"""SELECT bucket_ts, symbol, prices, volumes FROM packed, period
            WHERE bucket_ts BETWEEN t1 + {HALF} AND t2 + {HALF}""", PACKED
    ),
    "bucket_range_exact": _ticks(f"SELECT {TICK} FROM ticks, period WHERE ts BETWEEN t1 + {HALF} AND t2 + {HALF}"),
    "candle_range_scan": _ticks(
        f"SELECT {OHLC} FROM c1s, period WHERE symbol = 'AAPL' AND ts_bucket BETWEEN t1 AND t2", C1S
    ),
    # candles
    "ohlcv_1s": _ticks(f"SELECT {CANDLE} FROM c1s", C1S),
    "ohlcv_1m": _ticks(f"SELECT {CANDLE} FROM c1m", C1M),
    "ohlcv_1h": _with(SPARSE, _candles("c1h", "hour", "sparse"), select=f"SELECT {CANDLE} FROM c1h"),
    "ohlcv_1d": _with(SPARSE, _candles("c1d", "day", "sparse"), select=f"SELECT {CANDLE} FROM c1d"),
    "candles_any_resolution": _ticks(
        """SELECT ts_bucket, symbol, first(price ORDER BY ts, seq)::DOUBLE AS open_price, max(price)::DOUBLE AS high_price,
                  min(price)::DOUBLE AS low_price, last(price ORDER BY ts, seq)::DOUBLE AS close_price,
                  CAST(sum(volume) AS BIGINT) AS volume, count(*) AS tick_count, resolution
           FROM (SELECT ticks.*, resolution, make_timestamp(epoch_us(ts) // width * width) AS ts_bucket
                 FROM ticks, (VALUES ('500 milliseconds', 500000), ('30 seconds', 30000000), ('5 minutes', 300000000))
                             r(resolution, width))
           GROUP BY ts_bucket, symbol, resolution"""
    ),
    "ohlcv_from_buckets": _ticks(f"SELECT {CANDLE} FROM c1s", C1S),
    "avg_candle_1s": _ticks(_mean_candles("second")),
    "avg_candle_1m": _ticks(_mean_candles("minute")),
    "minute_scan": _ticks(
        f"""SELECT date_trunc('minute', ts) AS ts_bucket, symbol, min(price)::DOUBLE AS low_price,
            max(price)::DOUBLE AS high_price, CAST(sum(volume) AS BIGINT) AS volume {IN_PERIOD} GROUP BY 1, 2"""
    ),
    "candle_minute_scan": _ticks(f"SELECT {CANDLE} FROM c1m, period WHERE ts_bucket BETWEEN {MINUTES}", C1M),
    "second_activity": _ticks(
        """SELECT date_trunc('second', ts) AS ts_bucket, count(*) AS total_ticks, count(DISTINCT symbol) AS active_symbols
           FROM ticks GROUP BY ALL"""
    ),
    # packed layout
    "pack_buckets": _ticks("SELECT * FROM packed", PACKED_IN_FOURS),
    "unpack_buckets": _ticks(f"SELECT {TICK} FROM ticks"),
    "merge_buckets": _ticks("SELECT * FROM packed", PACKED),
    "merge_twice_appended": _ticks(
        """SELECT symbol, CAST(sum(volume) AS BIGINT) AS total_volume,
           count(DISTINCT date_trunc('second', ts)) AS bucket_count, count(*) AS tick_count FROM ticks GROUP BY symbol"""
    ),
    # aggregates
    "range_volume": _ticks(
        f"SELECT symbol, CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS tick_count {IN_PERIOD} GROUP BY symbol"
    ),
    "bucket_volume": _ticks(
        f"""SELECT symbol, CAST(sum(volume) AS BIGINT) AS total_volume,
            count(DISTINCT date_trunc('second', ts)) AS bucket_count, count(*) AS tick_count
            {BUCKET_IN_PERIOD} GROUP BY symbol"""
    ),
    "candle_volume": _ticks(
        f"""SELECT symbol, CAST(sum(volume) AS BIGINT) AS total_volume FROM c1m, period
            WHERE ts_bucket BETWEEN {MINUTES} GROUP BY symbol""", C1M
    ),
    "vwap": _ticks(
        f"SELECT symbol, sum(price * volume)::DOUBLE / nullif(sum(volume), 0)::DOUBLE AS vwap {IN_PERIOD} GROUP BY symbol"
    ),
    "vwap_double_prices": _ticks(
        """SELECT symbol, round(sum(p * volume) / nullif(sum(volume), 0), 8) AS vwap, round(avg(p), 8) AS avg_price
           FROM (SELECT *, price::DOUBLE * 1.00037::DOUBLE AS p FROM ticks) GROUP BY symbol"""
    ),
    "bucket_vwap": _ticks(
        f"""SELECT symbol, sum(price * volume)::DOUBLE / nullif(sum(volume), 0)::DOUBLE AS vwap
            {BUCKET_IN_PERIOD} GROUP BY symbol"""
    ),
    "minute_volume": _ticks(
        f"""SELECT date_trunc('minute', ts) AS ts_bucket, symbol, CAST(sum(volume) AS BIGINT) AS volume
            {IN_PERIOD} GROUP BY 1, 2"""
    ),
    "bucket_minute_volume": _ticks(
        f"""SELECT date_trunc('minute', ts) AS ts_bucket, symbol, CAST(sum(volume) AS BIGINT) AS volume
            {BUCKET_IN_PERIOD} GROUP BY 1, 2"""
    ),
    "bucket_second_volume": _ticks(
        f"""SELECT date_trunc('second', ts) AS ts_bucket, symbol, CAST(sum(volume) AS BIGINT) AS volume
            {BUCKET_IN_PERIOD} GROUP BY 1, 2"""
    ),
    "volatility_raw": _ticks(
        f"SELECT symbol, round(stddev_samp(price::DOUBLE), 8) AS volatility {IN_PERIOD} GROUP BY symbol"
    ),
    "volatility_candles": _ticks(
        f"""SELECT symbol, round(stddev_samp(close_price::DOUBLE), 8) AS volatility FROM c1m, period
            WHERE ts_bucket BETWEEN {MINUTES} GROUP BY symbol""", C1M
    ),
    "tick_statistics_from_candles": _ticks(
        f"""SELECT symbol, {MEAN} AS avg_price, sum(price * volume)::DOUBLE / nullif(sum(volume), 0)::DOUBLE AS vwap,
            round(stddev_samp(price::DOUBLE), 8) AS volatility
            FROM ticks, period WHERE date_trunc('minute', ts) BETWEEN {MINUTES} GROUP BY symbol"""
    ),
    "any_range_candle": _ticks(
        f"""SELECT symbol, first(price ORDER BY ts, seq)::DOUBLE AS open_price, max(price)::DOUBLE AS high_price,
            min(price)::DOUBLE AS low_price, last(price ORDER BY ts, seq)::DOUBLE AS close_price,
            CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS tick_count, {MEAN} AS avg_price,
            sum(price * volume)::DOUBLE / nullif(sum(volume), 0)::DOUBLE AS vwap, round(stddev_samp(price::DOUBLE), 8) AS volatility
            FROM ticks, period WHERE ts BETWEEN t1 + INTERVAL 730 MILLISECOND AND t2 + INTERVAL 410 MILLISECOND GROUP BY symbol"""
    ),
    "any_range_volume": _ticks(
        """SELECT symbol, CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS tick_count
           FROM ticks, period WHERE ts BETWEEN t1 + INTERVAL 360 MILLISECOND AND t2 - INTERVAL 120 MILLISECOND GROUP BY symbol"""
    ),
    "symbol_avg_range": _ticks(f"SELECT symbol, {MEAN} AS avg_price {IN_PERIOD} GROUP BY symbol"),
    "range_count": _ticks(f"SELECT count(*) AS row_count {IN_PERIOD}"),
    "extent": _ticks(
        """SELECT min(ts) AS data_start, max(ts) AS data_end, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span_seconds
           FROM ticks"""
    ),
    "high_water": _ticks(
        """SELECT max(ts) AS high_water, 'raw' AS layout FROM ticks
           UNION ALL SELECT max(date_trunc('second', ts)), 'packed' FROM ticks"""
    ),
    "kpis": _ticks(
        f"""SELECT symbol, last(close_price ORDER BY ts_bucket)::DOUBLE AS latest_price,
            CAST(sum(volume) AS BIGINT) AS total_volume, round(stddev_samp(close_price::DOUBLE), 8) AS volatility,
            coalesce(last(sma ORDER BY ts_bucket), 0.0)::DOUBLE AS current_sma
            FROM (SELECT c1s.*, CASE WHEN count(close_price) OVER w = 20 THEN {SMA} END AS sma
                  FROM c1s, period WHERE ts_bucket BETWEEN t1 AND t2 {FRAME20})
            GROUP BY symbol""", C1S
    ),
    "latest_price": _ticks(
        """SELECT symbol, max(ts) AS ts, last(price ORDER BY ts, seq)::DOUBLE AS price FROM ticks GROUP BY symbol"""
    ),
    "latest_price_one": _ticks(
        "SELECT symbol, ts, price::DOUBLE AS price FROM ticks WHERE symbol = 'AAPL' ORDER BY ts DESC, seq DESC LIMIT 1"
    ),
    "latest_close": _ticks(
        """SELECT symbol, max(ts_bucket) AS ts_bucket, last(close_price ORDER BY ts_bucket)::DOUBLE AS close_price
           FROM c1s GROUP BY symbol""", C1S
    ),
    # windows
    "sma20_candles": _ticks(
        f"""SELECT ts_bucket, symbol, close_price::DOUBLE AS close_price, round({SMA}, 8) AS sma20 FROM c1s {FRAME20}""", C1S
    ),
    "sma20_minute_candles": _ticks(f"SELECT {CANDLE}, round({SMA}, 8) AS sma20 FROM c1m {FRAME20}", C1M),
    "sma20_raw": _ticks(
        f"""SELECT ts_bucket, symbol, mean_price, round(avg(mean_price) OVER w, 8) AS sma20
            FROM (SELECT date_trunc('minute', ts) AS ts_bucket, symbol, {MEAN} AS mean_price FROM ticks GROUP BY 1, 2)
            {FRAME20}"""
    ),
    "sma20_full": _ticks(
        f"""SELECT ts_bucket, symbol, round(CASE WHEN count(close_price) OVER w = 20 THEN {SMA} END, 8) AS sma20
            FROM c1s {FRAME20}""", C1S
    ),
    "sma20_first100": _ticks(
        f"""SELECT ts_bucket, symbol, round({SMA}, 8) AS sma20 FROM c1s WHERE symbol = 'AAPL' {FRAME20}
            ORDER BY ts_bucket LIMIT 100""", C1S
    ),
    "moving_avg_valid": _ticks(
        """SELECT ts_bucket, symbol, seq, price::DOUBLE AS price,
                  round(CASE WHEN total < 5 THEN price::DOUBLE ELSE mean5 END, 8) AS smooth
           FROM (SELECT date_trunc('second', ts) AS ts_bucket, symbol, seq, price,
                        count(*) OVER (PARTITION BY symbol, date_trunc('second', ts)) AS total,
                        count(*) OVER w AS seen, sum(price) OVER w::DOUBLE / count(*) OVER w AS mean5
                 FROM ticks
                 WINDOW w AS (PARTITION BY symbol, date_trunc('second', ts) ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
           WHERE total < 5 OR seen = 5"""
    ),
    # joins and keyed writes
    "range_join_count": _ticks(
        """SELECT wid, t1, t2, count(ts) AS tick_count FROM windows LEFT JOIN ticks ON ts BETWEEN t1 AND t2
           GROUP BY ALL""", _windows(100, 10, 120)
    ),
    "range_join_upside_down": _ticks(
        """SELECT wid, t1, t2, count(ts) AS tick_count
           FROM (SELECT wid, CASE WHEN wid % 3 = 0 THEN t2 ELSE t1 END AS t1, CASE WHEN wid % 3 = 0 THEN t1 ELSE t2 END AS t2 FROM windows) w
           LEFT JOIN ticks ON ts BETWEEN t1 AND t2 GROUP BY ALL""", _windows(90, 10, 120)
    ),
    "range_join_symbol_avg": _ticks(
        f"SELECT wid, symbol, {MEAN} AS avg_price FROM windows JOIN ticks ON ts BETWEEN t1 AND t2 GROUP BY wid, symbol",
        _windows(50, 10, 60),
    ),
    "fk_rejects": _ticks(
        """SELECT seq, ts, symbol, price::DOUBLE AS price, nullif(volume, 0) AS volume,
                  CASE WHEN volume = 0 THEN 'null value' ELSE 'unknown symbol' END AS reason
           FROM ticks WHERE volume = 0 OR symbol IN ('TSMC', 'INTC')"""
    ),
    "fk_accepted": _ticks(f"SELECT {TICK} FROM ticks WHERE volume <> 0 AND symbol NOT IN ('TSMC', 'INTC')"),
    "insert_if_absent": _ticks(
        f"""SELECT {OHLC} FROM c1s, period WHERE ts_bucket < mid
            UNION ALL
            SELECT later.* FROM ({_mean_candles("second")}) later
            ANTI JOIN (SELECT ts_bucket, symbol FROM c1s, period WHERE ts_bucket < mid) s
            ON later.ts_bucket = s.ts_bucket AND later.symbol = s.symbol""", C1S
    ),
    "insert_first_of_duplicates": _ticks(
        f"""SELECT {TICK}, date_trunc('second', ts) AS ts_bucket FROM ticks
            QUALIFY row_number() OVER (PARTITION BY date_trunc('second', ts), symbol ORDER BY ts, seq) = 1"""
    ),
    "upsert_watermarks": _ticks(
        """SELECT symbol AS aggregation_interval, ts AS last_processed_ts, seq AS updated, volume
           FROM ticks, period WHERE ts < mid OR volume = 0
           QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY (ts >= mid) DESC, seq DESC) = 1"""
    ),
    # profiles and metrics
    "size_share": f"""
SELECT source, {PRETTY} AS size, bytes, round(bytes * 100.0::DOUBLE / sum(bytes) OVER (), 2) AS share_percent
FROM (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source)""",
    "storage_profile": _ticks(
        f"""SELECT tbl AS "table", {PRETTY} AS size, bytes, round(bytes * 100.0::DOUBLE / sum(bytes) OVER (), 2) AS share_percent
            FROM (SELECT tbl, CAST(sum(length) AS BIGINT) AS bytes FROM listing GROUP BY tbl)""", PACKED, C1M, BATCHES, LISTING
    ),
    "day_sizes": _ticks(
        """SELECT tbl AS "table", dt::VARCHAR AS dt, CAST(sum(length) AS BIGINT) AS bytes FROM listing GROUP BY ALL""",
        PACKED, C1M, BATCHES, LISTING
    ),
    "compression_profile": _ticks(
        f"""SELECT 'packed' AS "table", batch, stored_bytes, raw_bytes, round(ratio, 8) AS ratio, round(saved_percent, 8) AS saved_percent,
            CAST(sum(raw_bytes) OVER w AS BIGINT) AS cumulative_raw, CAST(sum(stored_bytes) OVER w AS BIGINT) AS cumulative_stored
            FROM compressed WINDOW w AS (ORDER BY batch)""", PACKED, BATCHES, COMPRESSED
    ),
    "compression_totals": _ticks(
        f"""SELECT 'packed' AS "table", CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(stored_bytes) AS BIGINT) AS stored_bytes,
            round(avg(ratio), 8) AS mean_ratio, round((1 - sum(stored_bytes) / sum(raw_bytes)) * 100, 8) AS saved_percent
            FROM compressed""", PACKED, BATCHES, COMPRESSED
    ),
    "batch_raw_bytes": _ticks("SELECT * FROM batches", BATCHES),
    "cumulative_bytes": _ticks(
        "SELECT *, CAST(sum(raw_bytes) OVER (ORDER BY batch) AS BIGINT) AS cumulative_bytes FROM batches", BATCHES
    ),
    "metric_speedup": _with(METRICS, select="""
SELECT query, naive_ms, opt_ms, naive_ms / greatest(opt_ms, 0.001) AS speedup
FROM (SELECT query, sum(ms) FILTER (variant = 'naive')::DOUBLE / count(*) FILTER (variant = 'naive') AS naive_ms,
             sum(ms) FILTER (variant = 'opt')::DOUBLE / count(*) FILTER (variant = 'opt') AS opt_ms
      FROM metrics GROUP BY query)"""),
    "metric_pivot": "SELECT user_id AS query, "
    + ", ".join(
        f"coalesce(max(value::DECIMAL(10,3)) FILTER (hour(ts) = {i})::VARCHAR, '-') AS {name}"
        for i, name in enumerate(HOURS)
    )
    + " FROM events GROUP BY user_id",
    "throughput_p95_clip": _with(METRICS, select="""
, rates AS (SELECT id, query, volume / greatest(ms::DOUBLE, 1e-9) AS rate FROM metrics),
caps AS (SELECT query, quantile_cont(rate, 0.95) AS cap FROM rates GROUP BY query),
clipped AS (SELECT id, query, cap, least(greatest(rate, 1e-6), cap) AS rate FROM rates JOIN caps USING (query)),
smoothed AS (
  SELECT query, cap, rate, count(*) OVER w AS seen, avg(rate) OVER w AS smooth FROM clipped
  WINDOW w AS (PARTITION BY query ORDER BY id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT query, round(max(cap), 6) AS p95_rate, round(avg(rate), 6) AS mean_rate, count(*) AS queries,
       round(avg(smooth) FILTER (seen = 5), 6) AS mean_smoothed
FROM smoothed GROUP BY query""").replace("\n\n,", ","),
    # incremental and streaming jobs
    "incremental_ohlcv_1s": _ticks(f"SELECT {CANDLE} FROM c1s WHERE {FINISHED}", C1S),
    "incremental_ohlcv_1m": _ticks(
        f"""SELECT {CANDLE} FROM c1m
            WHERE ts_bucket < (SELECT date_trunc('minute', max(ts)) FROM ticks)""", C1M
    ),
    "rewind_idempotent": _ticks(f"SELECT {CANDLE} FROM c1s WHERE {FINISHED}", C1S),
    "rebuild_days": _ticks(
        """SELECT ts_bucket, symbol, open_price::DOUBLE AS open_price, high_price::DOUBLE AS high_price,
           low_price::DOUBLE AS low_price, close_price::DOUBLE AS close_price, volume, tick_count
           FROM (SELECT ts_bucket, symbol, open_price + 0.01 AS open_price, high_price + 0.01 AS high_price,
                        low_price + 0.01 AS low_price, close_price + 0.01 AS close_price, volume, tick_count FROM c1s)
           WHERE ts_bucket::DATE > (SELECT min(ts)::DATE FROM ticks) AND ts_bucket < (SELECT date_trunc('second', max(ts)) FROM ticks)""", C1S
    ),
    "progress_table": _ticks(
        "SELECT '1s' AS aggregation_interval, date_trunc('second', max(ts)) AS last_processed_ts FROM ticks"
    ),
    "stream_ohlcv_1s": _ticks(f"SELECT {CANDLE} FROM c1s WHERE {CLOSED_SECONDS}", C1S),
    "stream_ohlcv_1m": _ticks(
        f"""SELECT {CANDLE} FROM c1m
            WHERE ts_bucket + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM ticks)""", C1M
    ),
    "stream_pack": _ticks("SELECT * FROM packed", PACKED),
    "stream_late_drop": _with(
        TICKS, "in_time AS (SELECT ticks.* FROM ticks, period WHERE NOT (symbol = 'TSLA' AND ts < third1))",
        _candles("c1s", "second", "in_time"), select=f"SELECT {CANDLE} FROM c1s WHERE {CLOSED_SECONDS}",
    ),
}
