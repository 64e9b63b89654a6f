"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key, ``-ln(u) / quality``; taking a source's
documents by ascending key is Efraimidis-Spirakis sampling with the qualities as
weights. ``u`` is a hash of the document's id and a seed, so that reruns agree.
A source with a target of two and a half times its size gives two complete
epochs, then the documents with the smallest keys until their words fill the
remaining half.

The cut is found without sorting a source. Its keys are mapped to 4,096 bins by
their expected distribution; bin sums, combined before the shuffle, show the bin
that holds the cut, and only this bin's rows are ranked. Every row then compares
its own key with its source's cut, so texts are never shuffled.

Defined cases: null or empty text has size 0 and is never taken. Null sources
are one source, the last. A null id draws the key of the seed alone. Rows that
repeat an id share a key and are taken one by one by size and text hash; of
equal rows, as many as fit. No rows give no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, count_of, packed
from tickloom.session import materialize

BINS = 4096


def lower_case_share(text: Column) -> Column:
    """A quality weight between 0.25 and 1: more for texts of mostly small letters."""
    share = count_of(text, r"\p{Ll}") / F.greatest(F.char_length(text), F.lit(1))
    return F.lit(0.25) + F.coalesce(share, F.lit(0.0)) * 0.75


def exponential_key(doc_id: Column, quality: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 12)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / quality


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Targets of (src, total) rows: shares by weight, at most ``most`` times the total.

    What a source cannot take is shared among the others, again by weight, until
    none is above. The final level is where the sources with the smallest ratio
    of cap to weight are full; sorted by that ratio it is a running sum. One row
    per source.
    """
    by_name = Window.orderBy("src")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    rows = rows.withColumn("cap", F.col("total") * float(most))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before, onward = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("total").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(onward))
    rows = rows.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    rows = rows.withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(everything)["level"])
    return rows.select("src", "total", F.when(F.col("full"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, quality=lower_case_share) -> DataFrame:
    """Every row of ``docs`` as ``row``, with size, source_size, target, taken and copies.

    ``copies`` says how often the mix takes the document, ``taken`` how many words that is.
    """
    # 's' sorts before 'z': named sources by code point, null last
    keyed = packed(docs).select(
        "row",
        F.coalesce(F.concat(F.lit("s"), F.col("row.source")), F.lit("z")).alias("src"),
        F.col("row.doc_id").alias("id"),
        F.xxhash64("row.text").alias("h"),
        count_of(F.col("row.text"), WORD).alias("size"),
        quality(F.col("row.text")).alias("quality"),
    ).withColumn("key", exponential_key(F.col("id"), F.col("quality"), seed))
    narrow = materialize(keyed.drop("row"), "mix-keys")

    totals = narrow.groupBy("src").agg(F.sum("size").alias("total"), F.avg("quality").alias("mean"))
    totals = materialize(totals, "mix-sources")
    plan = targets(totals.select("src", "total"), weights, most).join(totals.select("src", "mean"), "src")
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "total") + 1e-9), F.lit(0)))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("total"), F.lit(0.0)))
    plan = materialize(plan, "mix-targets")

    bin_of = F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean"))) * BINS), F.lit(BINS - 1))
    binned = narrow.join(plan.select("src", "mean", "rest"), "src").withColumn("bin", bin_of)
    sums = binned.groupBy("src", "rest", "bin").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("src").orderBy("bin"))
    edges = sums.withColumn("before", running - F.col("words")).where(F.col("before") <= F.col("rest"))
    edges = edges.groupBy("src").agg(F.max("bin").alias("cut_bin"), F.max_by("before", "bin").alias("before"))
    edges = materialize(edges, "mix-edges")

    # the cut: the last row that fits, which of its equals it is, and how many those are
    order = ["key", "id", "size", "h"]
    inside = binned.join(edges, "src").where(F.col("bin") == F.col("cut_bin"))
    in_order = Window.partitionBy("src").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    equals = Window.partitionBy("src", *order)
    filled = F.sum("size").over(in_order) + F.col("before") - F.col("size") / 2
    ranked = inside.withColumn("filled", filled).withColumn("place", F.count(F.lit(1)).over(in_order))
    ranked = ranked.withColumn("equals", F.count(F.lit(1)).over(equals)).withColumn("first", F.min("place").over(equals))
    cut = ranked.where(F.col("filled") <= F.col("rest")).groupBy("src").agg(
        F.max(F.struct(*order)).alias("cut"), F.max_by(F.struct("place", "equals", "first"), "place").alias("at"))
    cut = cut.select("src", "cut", (F.col("at.place") - F.col("at.first") + 1).alias("take"), F.col("at.equals").alias("equals"))
    plan = materialize(plan.join(edges.select("src", "cut_bin"), "src", "left").join(cut, "src", "left"), "mix-plan")

    out = keyed.join(plan, "src").withColumn("bin", bin_of)
    split = F.coalesce((F.col("equals") > F.col("take")) & (F.struct(*order) == F.col("cut")), F.lit(False))
    inner = (F.col("bin") == F.col("cut_bin")) & (F.struct(*order) <= F.col("cut"))
    picked = F.coalesce((F.col("bin") < F.col("cut_bin")) | inner, F.lit(False))
    if plan.where("equals > take").isEmpty():
        decided = out.withColumn("picked", picked)
    else:  # equal rows at a cut: any of them, as many as fit
        some = Window.partitionBy("src").orderBy("key")
        few = out.where(split).withColumn("picked", F.row_number().over(some) <= F.col("take"))
        decided = out.where(~split).withColumn("picked", picked).unionByName(few)
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("picked").cast("int")).otherwise(0)
    copies = F.least(copies, F.lit(most)).cast("long")
    return decided.select(
        "row", "size", F.col("total").alias("source_size"), "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    rows = mix(docs, **options).where(F.col("copies") > 0)
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
