"""Incremental and streaming jobs against the batch candles."""

from datetime import timedelta

import pytest
from core_cases import START, plan_of, rows_of
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators.buckets import merge_buckets, pack
from tickloom.operators.candles import ohlcv, rollup
from tickloom.plans import incremental
from tickloom.sources import tables, text
from tickloom.streaming import jobs

CANDLE = [field.name for field in schemas.CANDLES]


def stored(spark, root, resolution="1 second"):
    return rows_of(tables.scan_candles(spark, root, resolution).select(*CANDLE))


def finished(feed):
    """Candles of all seconds before the newest one."""
    last = feed.agg(F.max("ts")).first()[0].replace(microsecond=0)
    return rows_of(ohlcv(feed).where(F.col("ts_bucket") < F.lit(last).cast("timestamp_ntz")).select(*CANDLE))


def test_advance_in_steps(spark, feed, tmp_path):
    root = str(tmp_path / "store")
    for seconds in (3, 4, 9, None):
        incremental.advance(spark, feed, root, until=seconds and START + timedelta(seconds=seconds))
    assert stored(spark, root) == finished(feed)
    minute = rollup(ohlcv(feed)).where(F.col("ts_bucket") < F.lit("2024-04-12").cast("timestamp_ntz"))
    assert stored(spark, root, "1 minute") == rows_of(minute.select(*CANDLE))


def test_newest_second_waits(spark, feed, tmp_path):
    root = str(tmp_path / "store")
    position = incremental.advance(spark, feed.where("seq < 12"), root)
    assert position == START
    incremental.advance(spark, feed, root)
    assert stored(spark, root) == finished(feed)


def test_rewind_replays_without_change(spark, feed, tmp_path):
    root = str(tmp_path / "store")
    incremental.advance(spark, feed, root)
    before = stored(spark, root)
    incremental.rewind(spark, root, START)
    assert incremental.last_processed(spark, root) == START
    incremental.advance(spark, feed.withColumn("price", F.col("price") + 1), root)
    assert stored(spark, root) == before


def test_crash_before_progress_is_absorbed(spark, feed, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    incremental.advance(spark, feed, root, until=START + timedelta(seconds=5))
    with monkeypatch.context() as patch:
        patch.setattr(incremental, "set_progress", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            incremental.advance(spark, feed, root, until=START + timedelta(seconds=8))
    incremental.advance(spark, feed, root)
    assert stored(spark, root) == finished(feed)


def test_rebuild_corrects_days(spark, feed, tmp_path):
    root = str(tmp_path / "store")
    incremental.advance(spark, feed, root)
    corrected = feed.withColumn("price", (F.col("price") + 1).cast(schemas.PRICE))
    incremental.rebuild(spark, corrected, root, START, START + timedelta(days=1))
    assert stored(spark, root) == finished(corrected)
    incremental.rebuild(spark, feed, root, START, START)
    first_day = F.to_date("ts_bucket") == F.lit(START.date())
    got = tables.scan_candles(spark, root, "1 second").where(first_day).select(*CANDLE)
    assert rows_of(got) == rows_of(ohlcv(feed).where(first_day).select(*CANDLE))


def test_progress_merge_takes_the_last_write(spark):
    def progress(rows):
        return spark.createDataFrame(rows, schemas.PROGRESS)

    old = progress([("1s", START + timedelta(seconds=9), START), ("1m", START, START)])
    new = progress([("1s", START, START + timedelta(days=1))])
    merged = {row.aggregation_interval: row.last_processed_ts for row in incremental.merge_progress(old, new).collect()}
    assert merged == {"1s": START, "1m": START}


def test_progress_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    for i in range(14):
        incremental.set_progress(spark, root, START + timedelta(seconds=i))
    incremental.set_progress(spark, root, START, interval="1m")
    versions = tables.complete_versions(spark, f"{root}/progress")
    assert versions == list(range(5, 15))
    (tmp_path / "store" / "progress" / "version=14" / "_SUCCESS").unlink()
    rows = {row.aggregation_interval: row.last_processed_ts for row in incremental.read_progress(spark, root).collect()}
    assert rows == {"1s": START + timedelta(seconds=13)}


def arrivals(spark, parts, folder):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return jobs.stream_ticks(spark, folder, files_per_trigger=1)


def thirds(feed):
    return [feed.where((F.col("seq") >= a) & (F.col("seq") < a + 134)) for a in (0, 134, 268)]


def run(spark, job, stream, tmp_path, name="out"):
    query = job(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
    query.awaitTermination()
    return query, spark.read.parquet(str(tmp_path / name))


def test_stream_equals_batch(spark, feed, tmp_path):
    stream = arrivals(spark, thirds(feed), str(tmp_path / "in"))
    _, found = run(spark, jobs.run_candles, jobs.candles(stream), tmp_path)
    assert rows_of(found.select(*CANDLE)) == finished(feed)


def test_stream_hierarchy(spark, feed, tmp_path):
    stream = arrivals(spark, thirds(feed), str(tmp_path / "in"))
    _, found = run(spark, jobs.run_candles, jobs.rollup(jobs.candles(stream), "5 seconds"), tmp_path)
    last = feed.agg(F.max("ts")).first()[0]
    closed = rollup(ohlcv(feed), "5 seconds").where(
        F.expr("ts_bucket + INTERVAL 5 SECONDS") <= F.lit(str(last)).cast("timestamp_ntz")
    )
    assert rows_of(found.select(*CANDLE)) == rows_of(closed.select(*CANDLE))


def test_stream_pack_and_compaction(spark, feed, tmp_path):
    parts = [feed.where(F.col("seq") % 3 == i) for i in range(3)]
    stream = arrivals(spark, parts, str(tmp_path / "in"))
    run(spark, jobs.run_packed, stream, tmp_path)
    found = tables.scan_buckets(spark, str(tmp_path / "out"))
    columns = [field.name for field in schemas.BUCKETS]
    wanted = rows_of(pack(feed).select(*columns))
    assert found.count() > len(wanted)
    assert rows_of(merge_buckets(found.select(*columns)).select(*columns)) == wanted
    for day in ("2024-04-11", "2024-04-12"):
        jobs.compact_packed(spark, str(tmp_path / "out"), day)
    assert rows_of(tables.scan_buckets(spark, str(tmp_path / "out")).select(*columns)) == wanted


def test_replayed_packed_batches_are_written_once(spark, feed, tmp_path):
    stream = arrivals(spark, thirds(feed), str(tmp_path / "in"))
    run(spark, jobs.run_packed, stream, tmp_path)
    # the last batch was written but not committed: it comes again
    for name in ("2", ".2.crc"):
        (tmp_path / "out-checkpoint" / "commits" / name).unlink(missing_ok=True)
    _, found = run(spark, jobs.run_packed, jobs.stream_ticks(spark, str(tmp_path / "in"), 1), tmp_path)
    assert found.agg(F.sum("tick_count")).first()[0] == feed.count()


def test_only_the_first_batch_is_compared(spark, feed, tmp_path, monkeypatch):
    compared = []
    real = jobs.append_by_key
    monkeypatch.setattr(jobs, "append_by_key", lambda *args: (compared.append(1), real(*args)))
    stream = arrivals(spark, thirds(feed), str(tmp_path / "in"))
    _, found = run(spark, jobs.run_candles, jobs.candles(stream), tmp_path)
    assert rows_of(found.select(*CANDLE)) == finished(feed) and len(compared) <= 1
    files = found.inputFiles()
    for day in ("2024-04-11", "2024-04-12"):
        jobs.compact_candles(spark, str(tmp_path / "out"), day)
    after = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(after.select(*CANDLE)) == finished(feed) and len(after.inputFiles()) <= len(files)


def test_late_ticks_are_dropped_and_counted(spark, feed, tmp_path):
    late = feed.where("symbol = 'TSLA' AND seq < 100")
    parts = thirds(feed.join(late.select("seq"), "seq", "left_anti").select(*feed.columns))
    stream = arrivals(spark, [*parts, late], str(tmp_path / "in"))
    query, found = run(spark, jobs.run_candles, jobs.candles(stream), tmp_path)
    in_time = feed.where("NOT (symbol = 'TSLA' AND seq < 100)")
    assert rows_of(found.select(*CANDLE)) == finished(in_time)
    assert jobs.late_groups(query) > 0


def test_delay_keeps_late_ticks(spark, feed, tmp_path):
    late = feed.where("symbol = 'TSLA' AND seq < 100")
    parts = thirds(feed.where("NOT (symbol = 'TSLA' AND seq < 100)"))
    stream = arrivals(spark, [*parts, late], str(tmp_path / "in"))
    _, found = run(spark, jobs.run_candles, jobs.candles(stream, delay="15 seconds"), tmp_path)
    last = feed.agg(F.max("ts")).first()[0] - timedelta(seconds=15)
    closed = ohlcv(feed).where(F.expr("ts_bucket + INTERVAL 1 SECOND") <= F.lit(str(last)).cast("timestamp_ntz"))
    assert rows_of(found.select(*CANDLE)) == rows_of(closed.select(*CANDLE))


def test_an_uncommitted_batch_is_written_once(spark, feed, tmp_path):
    stream = arrivals(spark, thirds(feed), str(tmp_path / "in"))
    run(spark, jobs.run_candles, jobs.candles(stream), tmp_path)
    commits = tmp_path / "out-checkpoint" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    _, found = run(spark, jobs.run_candles, jobs.candles(jobs.stream_ticks(spark, str(tmp_path / "in"), 1)), tmp_path)
    assert rows_of(found.select(*CANDLE)) == finished(feed)


def test_tsv_round_trip_and_numbering(spark, feed, tmp_path):
    path = str(tmp_path / "tsv")
    text.write_tsv(feed.coalesce(1), path)
    loaded = text.load_tsv(spark, path)
    columns = ["symbol", "price", "volume", "ts"]
    assert rows_of(loaded.select(*columns)) == rows_of(feed.select(*columns))
    assert rows_of(ohlcv(loaded)) == rows_of(ohlcv(feed))


def test_numbers_follow_the_lines_however_files_are_split(spark, feed, tmp_path):
    path, lines = tmp_path / "tsv", [f"{r.symbol}\t{r.price}\t{r.volume}\t{r.ts}" for r in feed.orderBy("seq").collect()] * 6
    path.mkdir()
    for i in range(6):
        (path / f"part-{i}.tsv").write_text("".join(f"{line}\n" for line in lines[i * 400:(i + 1) * 400]))
    wanted = rows_of(ohlcv(spark.createDataFrame(
        [(i, *r[1:]) for i, r in enumerate(feed.orderBy("seq").collect() * 6)], schemas.TICKS)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        loaded = text.load_tsv(spark, str(path))
        assert text.load_tsv(spark, str(path), number=False).rdd.getNumPartitions() > 1024
        plan = plan_of(loaded)
        assert "BroadcastHashJoin" in plan and not any("price" in line for line in plan.split("\n") if "Exchange" in line)
        tables.write_ticks(loaded, str(tmp_path / "ticks"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    ticks = tables.scan_ticks(spark, str(tmp_path / "ticks"))
    in_order = [f"{r.symbol}\t{r.price}\t{r.volume}\t{r.ts}" for r in ticks.orderBy("seq").collect()]
    assert in_order == lines and sorted(r.seq for r in ticks.select("seq").collect()) == list(range(2400))
    assert rows_of(ohlcv(ticks)) == wanted and rows_of(ohlcv(ticks, key="long")) == wanted
    incremental.advance(spark, ticks, str(tmp_path / "store"))
    assert tables.scan_candles(spark, str(tmp_path / "store"), "1 second").count() == len({w[:2] for w in wanted}) - len(
        {w[:2] for w in wanted if w[0] == max(w[0] for w in wanted)})


def test_clock_times(spark):
    rows = spark.createDataFrame([("09:30",), (" 23:59:58 ",), ("soon",), (None,), ("25:00",)], "said STRING")
    found = [r.t for r in rows.select(text.clock_time("said", "08:15").alias("t")).collect()]
    assert found == [34200, 86398, 29700, 29700, 29700]


def test_rebuild_drops_days_without_ticks(spark, feed, tmp_path):
    root = str(tmp_path / "store")
    incremental.advance(spark, feed, root)
    left = feed.where(F.to_date("ts") > F.lit(START.date()))
    incremental.rebuild(spark, left, root, START, START + timedelta(days=1))
    days = {row.dt for row in tables.scan_candles(spark, root, "1 second").select("dt").distinct().collect()}
    assert days == {START.date() + timedelta(days=1)}
    assert all(row.dt in days for row in tables.scan_or_empty(spark, f"{root}/ohlcv_1m", schemas.CANDLES).select("dt").distinct().collect())


def test_bad_line_fails(spark, tmp_path):
    path = tmp_path / "bad.tsv"
    path.write_text("AAPL\tnot a price\t1\t2024-04-11 23:58:00\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        text.load_tsv(spark, str(path)).collect()


@pytest.mark.parametrize("level", ["seconds", "coarse"])
def test_late_ticks_are_counted_exactly_over_restarts(spark, feed, tmp_path, level):
    """The same late ticks in one run, then in a second run of the same query."""
    late = feed.where("symbol = 'TSLA' AND seq < 100")
    build = jobs.candles if level == "seconds" else lambda stream: jobs.rollup(jobs.candles(stream), "5 seconds")
    parts = thirds(feed.join(late.select("seq"), "seq", "left_anti").select(*feed.columns))
    counter = jobs.LateTicks(spark)
    try:
        stream = arrivals(spark, [*parts, late], str(tmp_path / "in"))
        query, found = run(spark, jobs.run_candles, build(stream), tmp_path)
        checkpoint = str(tmp_path / "out-checkpoint")
        dropped = late.count()
        assert counter.count(query, checkpoint) == dropped
        seen, kept = counter.totals(query)
        assert seen == feed.count() and kept == found.agg(F.sum("tick_count")).first()[0]
        assert jobs.held_ticks(spark, checkpoint) == seen - kept - dropped > 0
        late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query, _ = run(spark, jobs.run_candles, build(jobs.stream_ticks(spark, str(tmp_path / "in"), 1)), tmp_path)
        assert counter.count(query, checkpoint) == 2 * dropped
    finally:
        spark.streams.removeListener(counter)


def test_late_counts_do_not_end_with_the_kept_progress(spark):
    counter = jobs.LateTicks(spark)
    spark.streams.removeListener(counter)
    for batch in range(250):
        counter._add("q", batch, 10, 7)
    counter._add("q", 249, 12, 8)  # ran again
    counter._add("q", 249, 0, 0)  # idle
    query = type("Query", (), {"id": "q", "lastProgress": None})()
    assert counter.totals(query) == (249 * 10 + 12, 249 * 7 + 8)
