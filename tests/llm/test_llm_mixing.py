import random

from pyspark.sql import functions as F

from llm_cases import WORD, same_rows
from tickloom.llm import mixing

WEIGHTS = (5, 2, 1)


def brute_targets(totals, most=3):
    """Shares by weight; what is above the cap goes to the others, again and again."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(totals.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= most * totals[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = float(most * totals[s])
            left -= target[s]
        free -= full
    return target


def brute(rows):
    """rows: (doc_id, source, size, key); the copies of each row, by sorting every source."""
    totals = {}
    for _, source, size, _ in rows:
        totals[source] = totals.get(source, 0) + size
    target = brute_targets(totals)
    for source, total in totals.items():
        epochs = int(target[source] / total + 1e-9) if total else 0
        rest, filled, picking = target[source] - epochs * total, 0, True
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2]))
        for doc_id, _, size, _ in mine:
            filled += size
            picking = picking and filled - size / 2 <= max(rest, 0)
            yield doc_id, size, total, round(target[source], 6), min(3, epochs + picking) * size


def found(docs):
    out = mixing.mix(docs).select("row.doc_id", "size", "source_size", F.round("target", 6), "taken").collect()
    return [tuple(r) for r in out]


def keys(docs):
    quality = mixing.lower_case_share(F.col("text"))
    rows = docs.select("doc_id", "source", "text", mixing.exponential_key(F.col("doc_id"), quality, 17).alias("draw")).collect()
    return [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or "")), r["draw"]) for r in rows]


def test_against_sorting(edge_docs):
    same_rows(found(edge_docs), brute(keys(edge_docs)))


def test_many_documents_of_a_hot_source(spark):
    random_ = random.Random(4)
    rows = [(i, "hot" if random_.random() < 0.5 else f"s{random_.randrange(5)}", "Word " * random_.randrange(1, 40)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = found(docs)
    same_rows(got, brute(keys(docs)))
    assert sorted(got) == sorted(found(docs.repartition(7)))


def test_equal_keys_and_one_size(spark):
    docs = spark.createDataFrame([(7, "a", "x y")] * 50 + [(8, "b", "x y z")] * 400, "doc_id long, source string, text string")
    out = found(docs)
    assert abs(sum(r[4] for r in out if r[0] == 7) - 300) <= 2 and abs(sum(r[4] for r in out if r[0] == 8) - 1000) <= 3


def test_copies_and_columns(edge_docs):
    mixed = mixing.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    words = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    assert mixed.agg(words).first()[0] == sum(r[4] for r in found(edge_docs))


def test_empty(spark, no_docs):
    assert found(no_docs) == []
    none = spark.createDataFrame([(1, None, None), (2, "a", "")], "doc_id long, source string, text string")
    same_rows(found(none), [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])


def test_quality_weights_shift_the_draw(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("w").alias("text"))
    more = spark.range(4000).select((-F.col("id") - 1).alias("doc_id"), F.lit("b").alias("source"), F.lit("w").alias("text"))
    weight = lambda text: F.when(F.lit(True), F.lit(1.0))
    rows = mixing.mix(docs.union(more), weights=(1, 3), quality=weight).where("row.source = 'a'")
    assert abs(rows.agg(F.sum("taken")).first()[0] - 2000) <= 1
