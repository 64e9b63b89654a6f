from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from core_cases import plan_of, rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.timecols import tumbling
from tickloom.operators import moving
from tickloom.operators.candles import ohlcv
from tickloom.operators.kpis import kpis
from tickloom.operators.moving import first_sma_rows, moving_average, running_total, sma

DAY = datetime(2024, 1, 1)


def series(spark, lengths):
    """One series per name, its points at uneven seconds, with some NULL values."""
    rows = []
    for name, length in lengths.items():
        for i in range(length):
            value = None if i % 17 == 11 else Decimal((i * 7919) % 1000) / 100
            rows.append((name, DAY + timedelta(seconds=i * 3 + (i // 5) * 40), value))
    return spark.createDataFrame(rows, "symbol STRING, ts_bucket TIMESTAMP_NTZ, close_price DECIMAL(10,2)")


def expected(rows, width, frames):
    out = {}
    for name in {row.symbol for row in rows}:
        points = sorted((row.ts_bucket, row.close_price) for row in rows if row.symbol == name)
        for i, (at, value) in enumerate(points):
            frame = [v for _, v in points[max(0, i - width + 1):i + 1]]
            seen = [v for v in frame if v is not None]
            mean = float(sum(seen)) / len(seen) if seen else None
            if frames == "full" and len(seen) < width:
                mean = None
            if frames == "valid":
                if len(points) < width:
                    mean = float(value) if value is not None else None
                elif len(frame) < width:
                    continue
            out[name, at] = mean
    return out


@pytest.mark.parametrize("frames", ["partial", "full", "valid"])
@pytest.mark.parametrize("chunk", [7, 60, 900, 10**9])
def test_chunks_do_not_change_the_result(spark, frames, chunk):
    df = series(spark, {"LONG": 300, "SHORT": 12, "EDGE": 20, "ONE": 1})
    cut = F.expr(f"unix_seconds(CAST(ts_bucket AS TIMESTAMP)) DIV {chunk}")
    found = moving_average(
        df, "close_price", "m", keys=["symbol"], order="ts_bucket", chunk=cut, width=20, frames=frames
    )
    got = {(row.symbol, row.ts_bucket): row.m for row in found.collect()}
    assert got == expected(df.collect(), 20, frames)


def test_sma_shuffles_the_candles_once(spark):
    df = series(spark, {"LONG": 300}).repartition(3)
    averaged = sma(df, chunk="10 minutes")
    averaged.collect()
    plan = plan_of(averaged)
    assert "ReusedExchange" in plan


def test_first_rows_take_the_top_before_the_window(spark):
    df = series(spark, {"LONG": 300, "OTHER": 50})
    first = first_sma_rows(df, "LONG", rows=30)
    wanted = expected([row for row in df.collect() if row.symbol == "LONG"], 20, "partial")
    got = first.collect()
    assert len(got) == 30 and all(wanted[row.symbol, row.ts_bucket] == row.sma20 for row in got)
    plan = plan_of(first)
    assert plan.index("Window") < plan.index("TakeOrdered")


def test_running_total(spark):
    df = spark.createDataFrame(
        [(key, i, None if i == 5 else i * 2) for key in "ab" for i in range(40)], "key STRING, i INT, v INT"
    )
    found = running_total(df, "v", "total", keys=["key"], order="i", chunk=F.expr("i DIV 6"))
    for row in found.collect():
        assert row.total == sum(j * 2 for j in range(row.i + 1) if j != 5)
    whole = running_total(df.where("key = 'a'"), "v", "total", keys=[], order="i", chunk=F.expr("i DIV 6"))
    assert whole.where("i = 39").first().total == sum(j * 2 for j in range(40)) - 10


def test_kpis(spark):
    df = series(spark, {"LONG": 60, "SHORT": 5}).na.fill(0).withColumn("volume", F.lit(2).cast("bigint"))
    df = df.withColumn("close_price", F.coalesce("close_price", F.lit(1).cast("decimal(10,2)")))
    found = {row.symbol: row for row in kpis(df).collect()}
    averages = expected(df.collect(), 20, "full")
    last = max(at for name, at in averages if name == "LONG")
    assert found["LONG"].current_sma == averages["LONG", last]
    assert found["SHORT"].current_sma == 0.0
    assert found["LONG"].total_volume == 120
    assert "WindowGroupLimit" in plan_of(kpis(df))


def test_a_series_of_a_hundred_thousand_chunks_meets_in_no_task(spark, monkeypatch):
    """Chunks of two rows, fewer than the width, so that every row is an edge of its chunk."""
    rows = spark.range(200_000).select(F.lit("A").alias("symbol"), F.col("id").alias("n"), F.expr("CAST(id * 37 % 101 AS DOUBLE)").alias("v"))
    seen, real = [], moving._frame_columns
    monkeypatch.setattr(moving, "_frame_columns", lambda df, *args: (seen.append(df), real(df, *args))[1])
    found = moving.moving_average(rows, "v", "m", keys=["symbol"], order="n", chunk=moving.number_chunks("n", 2), width=5)
    assert len(seen) == 3
    largest = [df.groupBy(*key).count().agg(F.max("count")).first()[0] for df, key in zip(seen, (["symbol", "_chunk0"], ["symbol", "_chunk1"], ["symbol"]))]
    assert largest[0] == 2 and largest[1] == 2 * moving.CHUNKS and largest[2] <= 8 * (200_000 // largest[1] + 1)
    frame = Window.partitionBy("symbol").orderBy("n").rowsBetween(-4, 0)
    wrong = found.join(rows.select("n", F.avg("v").over(frame).alias("w")), "n").where(F.abs(F.col("m") - F.col("w")) > 1e-9)
    assert found.count() == 200_000 and wrong.count() == 0


@pytest.mark.parametrize("frames", ["partial", "full", "valid"])
def test_levels_of_chunks_give_the_result_of_one(feed, monkeypatch, frames):
    monkeypatch.setattr(moving, "CHUNKS", 3)
    closes = ohlcv(feed)
    for chunk in ("1 second", "4 seconds"):
        levels = moving.time_chunks("ts_bucket", chunk)[:4]
        args = dict(keys=["symbol"], order="ts_bucket", width=6, frames=frames)
        found = moving.moving_average(closes, "close_price", "m", chunk=levels, **args)
        wanted = moving.moving_average(closes, "close_price", "m", chunk=tumbling("ts_bucket", "30 days"), **args)
        assert rows_of(found.select("symbol", "ts_bucket", "m")) == rows_of(wanted.select("symbol", "ts_bucket", "m"))
