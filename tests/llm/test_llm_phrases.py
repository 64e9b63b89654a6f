import hashlib

from pyspark.sql import functions as F

from llm_cases import TERM, edge_texts, lowered, prose, same_rows
from tickloom.llm import phrases

ITEMS = [(1, prose(1, 14)), (2, prose(1, 300).upper()), (3, "eins zwei DREI"), (10, "one"), (4, None), (5, ""), (6, "?! ..."), (7, "never seen at all here"),
         (8, "the same line here the same line here the same line here"), (1, prose(1, 14)), (1, "Äpfel Äpfel"), (None, prose(98, 30)), (9, " ".join(prose(99, 20_000, 3000).split()[500:512]) + " tail words")]


def bench(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "item_id long, text string, word string, n int")


def brute(docs, items):
    windows = []
    for item, text in items:
        w = TERM.findall(lowered(text))
        size = min(10, len(w))
        windows += [("" if item is None else str(item), tuple(w[p:p + size])) for p in range(len(w) - size + 1) if size]
    for doc_id, text, _ in docs:
        w, hit, its = TERM.findall(lowered(text)), set(), set()
        places = {}
        for p, word in enumerate(w):
            places.setdefault(word, []).append(p)
        for item, window in windows:
            for p in places.get(window[0], []):
                if tuple(w[p:p + len(window)]) == window:
                    hit.update(range(p, p + len(window)))
                    its.add(item)
        yield doc_id, len(w), len(hit), sorted(its)


def rows_of(frame):
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in frame.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "items").collect()]


def test_against_brute_force(spark, edge_docs):
    same_rows(rows_of(phrases.contamination(edge_docs, bench(spark))), brute(edge_texts(), ITEMS))


def test_empty_sides(spark, edge_docs, no_docs):
    assert rows_of(phrases.contamination(no_docs, bench(spark))) == []
    assert {r[2] for r in rows_of(phrases.contamination(edge_docs, bench(spark, [])))} == {0}


def test_clean_documents_keep_their_columns(spark, edge_docs):
    clean = phrases.clean_documents(edge_docs, bench(spark))
    assert clean.columns == edge_docs.columns
    same_rows([(r["doc_id"], hashlib.md5((r["text"] or "-").encode()).hexdigest()) for r in clean.select("doc_id", "text").collect()],
              [(i, hashlib.md5((t or "-").encode()).hexdigest()) for (i, t, _), (_, _, n, _) in zip(edge_texts(), brute(edge_texts(), ITEMS), strict=True) if not n])


def near_brute(docs, items, within):
    """(id, start, pos) at which all words of a window of an item are among the next ``within`` words."""
    for doc_id, text in docs:
        w = TERM.findall(lowered(text))
        for item, phrase in items:
            wanted = TERM.findall(lowered(phrase))
            size = min(10, len(wanted))
            for start in range(len(wanted) - size + 1) if size else ():
                window = set(wanted[start:start + size])
                for pos, word in enumerate(w):
                    if word in window and window <= set(w[pos:pos + within]):
                        yield doc_id, item, start, pos


def near_found(spark, docs, items, within):
    words = phrases.items_of(bench(spark, items))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = phrases.proximity_matches(phrases.build_index(frame, words), words, within)
    names = words.select("item", "item_id").distinct()
    return [(r[0], int(r[1]), r[2], r[3]) for r in found.join(names, "item").select("id", "item_id", "start", "pos").collect()]


def test_proximity(spark):
    docs = [(1, "x " * 5 + "alpha y y beta"), (2, "alpha " + "y " * 50 + "beta"), (3, "beta alpha"), (None, "beta alpha alpha"), (3, "beta alpha")]
    items = phrases.items_of(bench(spark, [(1, "alpha beta")]))
    index = phrases.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert index.count() == sum(len(t.split()) for _, t in docs)
    found = phrases.proximity_matches(index, items, within=10).select("id", "pos").collect()
    same_rows(found, [(1, 5), (3, 0), (None, 0)])
    assert phrases.proximity_matches(index.where(F.lit(False)), items).count() == 0


def test_proximity_of_items_longer_than_the_span(spark):
    long_item = prose(70, 60, 500)
    mixed_up = long_item.split()
    mixed_up[3:9] = mixed_up[3:9][::-1]
    docs = [(1, long_item), (2, " ".join(mixed_up)), (3, prose(71, 4000, 12)), (4, long_item.replace(" ", " y y y ")), (5, None), (6, "the cat")]
    items = [(1, long_item), (2, prose(72, 11, 12)), (3, "the zzz yyy"), (4, "w1 W1 w2"), (5, None), (6, "?")]
    for within in (10, 30):
        wanted = set(near_brute(docs, items, within))
        assert {r[0] for r in wanted} >= {1, 2, 3} and not any(r[1] == 3 for r in wanted)
        same_rows(near_found(spark, docs, items, within), wanted)


def test_texts_are_not_shuffled(edge_docs, spark):
    lines = lambda frame: frame._jdf.queryExecution().executedPlan().toString().split("\n")
    found = lines(phrases.contamination(edge_docs, bench(spark)))
    counted = next(n for n, line in enumerate(found) if "regexp_extract_all" in line)
    assert "Exchange hashpartitioning" in found[counted - 1] and found[counted].count(" AS ") == 3
    assert not any("SortMergeJoin" in line for line in lines(phrases.clean_documents(edge_docs, bench(spark))))
