import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.sizes import pretty_size
from tickloom.operators.metrics import percentile, query_by_engine, speedup, throughput
from tickloom.plans import storage


def values():
    rng = np.random.default_rng(7)
    return {
        "uniform": rng.uniform(0, 1, 20_000),
        "heavy": rng.pareto(0.5, 20_000),
        "ties": np.repeat([1.0, 2.0, 3.0], [9_000, 9_500, 1_500]),
        "constant": np.full(5_000, 4.25),
        "few": np.array([3.0, 1.0, 2.0, 10.0]),
        "one": np.array([5.0]),
    }


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_percentile_is_exact(spark, p):
    data = values()
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k STRING, v DOUBLE")
    found = {row.k: row.percentile for row in percentile(df.repartition(5), "k", "v", p).collect()}
    assert set(found) == set(data)
    for key, numbers in data.items():
        assert found[key] == pytest.approx(np.percentile(numbers, p * 100), rel=1e-12)


def test_throughput(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, int(n), float(e)) for i, (n, e) in enumerate(zip(rng.integers(0, 100, 50), rng.uniform(0, 2, 50)))]
    rows += [("b", i, 10, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "q STRING, id BIGINT, row_count INT, elapsed DOUBLE")
    found = {row.q: row for row in throughput(df, "q", "id", F.expr("id DIV 8")).collect()}
    rates = np.array([n / max(e, 1e-9) for q, _, n, e in rows if q == "a"])
    clipped = np.clip(rates, 1e-6, np.percentile(rates, 95))
    assert found["a"].mean_rate == pytest.approx(clipped.mean())
    assert found["a"].mean_smoothed == pytest.approx(np.convolve(clipped, np.ones(5) / 5, mode="valid").mean())
    assert found["b"].mean_smoothed == pytest.approx(1e10)


def test_speedup_has_a_floor(spark):
    df = spark.createDataFrame(
        [("q", "naive", "2.000"), ("q", "naive", "4.000"), ("q", "opt", "0.000")], "query STRING, variant STRING, ms STRING"
    ).withColumn("ms", F.col("ms").cast("decimal(10,3)"))
    assert tuple(speedup(df).first()) == ("q", 3.0, 0.0, 3000.0)


def test_pivot_marks_what_is_missing(spark):
    df = spark.createDataFrame([("q1", "raw", 2), ("q1", "raw", 5), ("q2", "packed", 1)], "q STRING, e STRING, ms INT")
    found = {row.q: (row.raw, row.packed) for row in query_by_engine(df, "q", "e", "ms", ["raw", "packed"]).collect()}
    assert found == {"q1": ("5", "-"), "q2": ("-", "1")}


@pytest.mark.parametrize("size,text", [
    (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10751, "10 kB"), (10752, "11 kB"),
    (10485247, "10239 kB"), (10485248, "10 MB"), (123456789, "118 MB"), (5 << 40, "5120 GB"), (1 << 50, "1024 TB"),
])
def test_pretty_size(spark, size, text):
    assert spark.range(1).select(pretty_size(F.lit(size).cast("bigint")).alias("s")).first().s == text


def test_storage_and_compression(spark, feed, tmp_path):
    root = str(tmp_path / "market")
    storage.write_codecs(feed, root, ("uncompressed", "zstd"))
    profile = storage.storage_profile(spark, root).collect()
    assert {row.table for row in profile} == {
        f"{layout}-{codec}" for layout in ("ticks", "buckets") for codec in ("uncompressed", "zstd")
    }
    assert sum(row.share_percent for row in profile) == pytest.approx(100, abs=0.05)
    sizes = [row.bytes for row in profile]
    assert sizes == sorted(sizes, reverse=True)

    from tickloom.sources.listing import list_files

    by_day = storage.batch_raw_bytes(feed, "1 day").select(F.to_date("batch").cast("string").alias("dt"), "raw_bytes")
    measured = storage.compression_profile(list_files(spark, root), by_day)
    days = measured.where("table = 'ticks-zstd'").orderBy("dt").collect()
    assert len(days) == 2
    assert days[1].cumulative_raw == days[0].raw_bytes + days[1].raw_bytes
    totals = {row.table: row for row in storage.compression_totals(measured).collect()}
    assert totals["ticks-zstd"].raw_bytes == by_day.agg(F.sum("raw_bytes")).first()[0]


def test_batch_bytes_count_the_text(make_ticks):
    ticks = make_ticks([(1, 0, "AAPL", "10.50", 7)])
    line = "AAPL\t10.50\t7\t2024-04-11 23:59:58\n"
    assert storage.batch_raw_bytes(ticks).first().raw_bytes == len(line)
