"""Summaries of query measurements."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import exact
from tickloom.operators.moving import moving_average
from tickloom.session import materialize


def speedup(metrics: DataFrame, variants: tuple[str, str] = ("naive", "opt")) -> DataFrame:
    """Mean latency per query and variant, and how much faster the second one is."""
    slow, fast = variants
    means = metrics.groupBy("query").pivot("variant", list(variants)).agg(exact.mean(metrics, "ms"))
    factor = F.col(slow) / F.greatest(F.col(fast), F.lit(0.001))
    return means.select("query", F.col(slow).alias("naive_ms"), F.col(fast).alias("opt_ms"), factor.alias("speedup"))


def query_by_engine(metrics: DataFrame, query: str, engine: str, value: str, engines: list[str]) -> DataFrame:
    """One row per query, one text column per engine, ``-`` where none was measured.

    Several measurements of a pair show as their maximum.
    """
    wide = metrics.groupBy(query).pivot(engine, engines).agg(F.max(value))
    cells = [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("-")).alias(name) for name in engines]
    return wide.select(query, *cells)


def percentile(df: DataFrame, key: str, value: str, p: float, accuracy: int = 10_000, points: int = 32) -> DataFrame:
    """Exact, linearly interpolated percentile of a DOUBLE column per key.

    The built-in exact percentile holds all distinct values of a key in one
    task. Here every key is narrowed twice, by the same two steps at any size. A
    sketch of bounded size gives values around the wanted ranks, which split a
    key's rows into below, around and above; exact counts tell which of these
    holds the ranks. That part is split again at ``points`` of its quantiles, and
    only the bins that hold the ranks are ranked. Sketches choose where to
    cut; ranks come from counts, so a poor sketch costs time, not exactness.

    The part of each key that holds its ranks, about ``20 / accuracy`` of the
    rows, is written to the shared folder.
    """
    margin = 10 / accuracy
    around = [max(p - margin, 0.0), min(p + margin, 1.0)]
    span = df.groupBy(key).agg(F.percentile_approx(value, around, accuracy).alias("_around"), F.count(value).alias("_total"))
    position = (F.col("_total") - 1) * F.lit(p)
    span = span.where("_total > 0").select(
        key, F.col("_around")[0].alias("_lo"), F.col("_around")[1].alias("_hi"),
        position.alias("_pos"), F.floor(position).alias("_low_rank"), F.ceil(position).alias("_high_rank"),
    )
    span = materialize(span, "percentile-span")

    part = F.when(F.col(value) < F.col("_lo"), 0).when(F.col(value) <= F.col("_hi"), 1).otherwise(2)
    placed = df.where(F.col(value).isNotNull()).join(span, key).withColumn("_part", part)
    wanted = _holding(placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n")), span, key, "_part", [key])
    inside = placed.select(key, "_part", value).join(wanted, [key, "_part"])
    inside = inside.groupBy(key, "_part", "_before", value).agg(F.count(F.lit(1)).alias("_n"))
    inside = materialize(inside, "percentile-part")

    cuts = inside.groupBy(key, "_part").agg(
        F.percentile_approx(value, [i / points for i in range(1, points)], accuracy).alias("_cuts"))
    bin_of = F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    binned = inside.join(cuts, [key, "_part"]).withColumn("_bin", bin_of).drop("_cuts")
    counts = binned.groupBy(key, "_part", "_before", "_bin").agg(F.sum("_n").alias("_n"))
    chosen = _holding(counts, span, key, "_bin", [key, "_part"], F.col("_before"))
    along = Window.partitionBy(key, "_part", "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.drop("_before").join(chosen, [key, "_part", "_bin"]).join(span.select(key, "_low_rank", "_high_rank"), key)
    ranked = ranked.withColumn("_through", F.col("_before") + F.sum("_n").over(along))

    def at(rank: str) -> Column:
        found = (F.col("_through") - F.col("_n") <= F.col(rank)) & (F.col(rank) < F.col("_through"))
        return F.max(F.when(found, F.col(value)))

    ends = ranked.groupBy(key).agg(at("_low_rank").alias("_low"), at("_high_rank").alias("_high"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_pos") - F.col("_low_rank"))
    return span.join(ends, key).select(key, between.alias("percentile"))


def _holding(counts: DataFrame, span: DataFrame, key: str, along: str, within: list[str], start: Column | None = None) -> DataFrame:
    """The groups of ``counts`` that hold a wanted rank, with the number of rows ``_before`` them."""
    running = Window.partitionBy(*within).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(running), F.lit(0)) + (F.lit(0) if start is None else start)
    placed = counts.withColumn("_from", before).join(span.select(key, "_low_rank", "_high_rank"), key)
    holds = [(F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_from") + F.col("_n")) for rank in ("_low_rank", "_high_rank")]
    return placed.where(holds[0] | holds[1]).select(*dict.fromkeys([*within, along]), F.col("_from").alias("_before"))


def throughput(measured: DataFrame, key: str, order: str, chunk: Column, width: int = 5) -> DataFrame:
    """Rows per second of each measurement, tamed and averaged per key.

    ``measured`` has ``row_count`` and ``elapsed`` seconds. Rates are clipped
    to [1e-6, 95th percentile]; ``mean_rate`` is their mean and
    ``mean_smoothed`` the mean after a moving average of ``width``.
    """
    rates = measured.withColumn("_rate", F.col("row_count") / F.greatest(F.col("elapsed"), F.lit(1e-9)))
    caps = materialize(percentile(rates, key, "_rate", 0.95), "percentile-caps")
    clipped = rates.join(caps, key).select(
        key, order, "percentile", F.least(F.greatest("_rate", F.lit(1e-6)), "percentile").alias("_rate")
    )
    smooth = moving_average(
        clipped, "_rate", "_smooth", keys=[key], order=order, chunk=chunk, width=width, frames="full"
    )
    return smooth.groupBy(key).agg(
        F.max("percentile").alias("p95_rate"),
        F.avg("_rate").alias("mean_rate"),
        F.count(F.lit(1)).alias("queries"),
        # A series shorter than the width stays as it is.
        F.coalesce(F.avg("_smooth"), F.avg("_rate")).alias("mean_smoothed"),
    )
