"""Benchmark decontamination with a positional inverted index.

The index holds one posting (term, document, position) per occurrence of a term,
as Parquet in the shared folder; a term is the 64-bit hash of a lower-cased
word. Given a test set, only its vocabulary is indexed: the vocabulary has a
checked size and is broadcast, so postings are made by one pass over the texts
without a shuffle.

A phrase search starts from the rarest terms. Every window of an item picks the
``RAREST`` of its words with the fewest postings in the whole index. Their lists,
shifted by the word's place in the item, are intersected: a document stays a
candidate for a window at a shift when all of the window's shifted lists meet
there. Frequent words' lists are never joined. Candidates, few, are then checked
word by word in their own texts; runs of 10 agreeing words are exact occurrences
of windows.

Proximity search works on the same postings and windows: all words of a window,
in any order, within a span of words. Each occurrence of a window's rarest term
is an anchor; the other terms' postings around it are found by position blocks.

Defined cases: null or empty texts have no words and match nothing. Items of
fewer than 10 words, but not none, are one window. Repeated items and rows
count once per id and row. Documents are told apart by id and text hash, so
repeated ids with other texts keep their own results. No rows give no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import TERM, count_of, lower_ascii, packed, words
from tickloom.session import materialize

WINDOW = 10
RAREST = 3
BROADCAST_BYTES = 64 << 20


def broadcast_checked(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its counted rows fit; beyond that Spark plans a shuffle."""
    return F.broadcast(df) if df.count() * bytes_per_row <= limit else df


def keyed(docs: DataFrame) -> DataFrame:
    """Rows packed, beside their id and a hash of the text."""
    return packed(docs).select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("h"))


def terms_of(text: Column) -> Column:
    return words(text, TERM)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, ipos, word, term, n): the words of each distinct item, in place."""
    items = packed(benchmark).select(
        F.coalesce(F.col("row.item_id").cast("string"), F.lit("")).alias("item_id"), F.col("row.text").alias("text")).distinct()
    tokens = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), terms_of(F.col("text")).alias("tokens"))
    exploded = tokens.select("item_id", "item", F.size("tokens").alias("n"), F.posexplode("tokens").alias("ipos", "raw"))
    word = exploded.withColumn("word", lower_ascii(F.col("raw"))).drop("raw")
    return word.withColumn("term", F.xxhash64("word"))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings (id, h, pos, term) of ``docs`` in the shared folder, of all terms or a vocabulary's."""
    tokens = keyed(docs).select("id", "h", F.posexplode(terms_of(F.col("row.text"))).alias("pos", "raw"))
    postings = tokens.select("id", "h", "pos", F.xxhash64(lower_ascii(F.col("raw"))).alias("term"))
    if vocabulary is not None:
        postings = postings.join(broadcast_checked(vocabulary.select("term").distinct(), 32), "term", "left_semi")
    return materialize(postings.select("id", "h", "pos", "term"), "postings")


def list_lengths(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def spread_windows(items: DataFrame, lengths: DataFrame) -> DataFrame:
    """Every window's words (item, start, len, ipos, term, cf); cf counts the term's postings, 0 for unknown terms."""
    known = items.join(lengths, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    length = F.least(F.col("n"), F.lit(WINDOW))
    first = F.greatest(F.col("ipos") - WINDOW + 1, F.lit(0))
    last = F.least(F.col("ipos"), F.col("n") - length)
    return known.withColumn("start", F.explode(F.sequence(first, last))).withColumn("len", length)


def rarest_probes(items: DataFrame, lengths: DataFrame, rarest: int = RAREST) -> DataFrame:
    """The words of each window whose lists are intersected: (item, start, len, ipos, term, need).

    Windows with a word that no document has are dropped: they cannot occur.
    """
    of_window = Window.partitionBy("item", "start")
    ranked = spread_windows(items, lengths).withColumn("rank", F.row_number().over(of_window.orderBy("cf", "ipos")))
    ranked = ranked.withColumn("least", F.min("cf").over(of_window))
    return ranked.where((F.col("rank") <= rarest) & (F.col("least") > 0)).select(
        "item", "start", "len", "ipos", "term", F.least("len", F.lit(rarest)).alias("need"))


def candidates(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, h, item, shift, start, len): the windows whose probes all meet at a shift.

    Lists are joined once per word of an item. Shifts at which fewer words meet
    than a window asks for, nearly all, are dropped before windows are looked at.
    """
    listed = probes.select("item", "ipos", "term", "need").distinct()
    met = index.join(broadcast_checked(listed, 64), "term").select(
        "id", "h", "item", "need", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos")
    at = ["id", "h", "item", "shift"]
    gathered = met.groupBy(*at).agg(F.collect_set("ipos").alias("met"), F.first("need").alias("need"))
    enough = gathered.where(F.size("met") >= F.col("need")).select(*at, F.explode("met").alias("ipos"))
    windows = enough.join(broadcast_checked(probes.drop("term"), 64), ["item", "ipos"]).groupBy(*at, "start", "len", "need")
    return windows.agg(F.count(F.lit(1)).alias("words")).where(F.col("words") == F.col("need")).select(*at, "start", "len")


def occurrences(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """Exact runs (id, h, item, first, length) of agreeing words, as long as a window or longer.

    Only the words of candidate windows are compared, each once.
    """
    at = ["id", "h", "item", "shift"]
    places = found.select(*at, F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("ipos")).distinct()
    wanted = places.join(broadcast_checked(items, 128), ["item", "ipos"]).select(
        *at, "ipos", "n", (F.col("shift") + F.col("ipos")).alias("pos"), "word")
    texts = keyed(docs).select("id", "h", F.col("row.text").alias("text"))
    some = found.select("id", "h").distinct()
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])
    texts = texts.join(some, same(texts, some), "left_semi").dropDuplicates(["id", "h"])
    spread = texts.select("id", "h", F.posexplode(terms_of(F.col("text"))).alias("pos", "raw")).select(
        "id", "h", "pos", lower_ascii(F.col("raw")).alias("word"))
    hits = wanted.join(spread, same(wanted, spread) & (wanted["pos"] == spread["pos"]) & (wanted["word"] == spread["word"])).select(
        wanted["id"], wanted["h"], "item", "shift", "ipos", "n")
    runs = hits.withColumn("run", F.col("ipos") - F.row_number().over(Window.partitionBy(*at).orderBy("ipos")))
    runs = runs.groupBy(*at, "run").agg(F.min("ipos").alias("low"), F.count(F.lit(1)).alias("length"), F.first("n").alias("n"))
    return runs.where(F.col("length") >= F.least(F.col("n"), F.lit(WINDOW))).select(
        "id", "h", "item", (F.col("shift") + F.col("low")).alias("first"), "length")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, index: DataFrame | None = None, rarest: int = RAREST) -> tuple[DataFrame, DataFrame]:
    """The exact runs of all items in all documents, and the items' words."""
    items = materialize(items_of(benchmark), "items")
    index = build_index(docs, items) if index is None else index
    probes = materialize(rarest_probes(items, list_lengths(index), rarest), "probes")
    found = materialize(candidates(index, probes), "candidates")
    return occurrences(docs, items, found), items


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every row of ``docs`` id, n_words, n_hit, n_items, items (ids, sorted as strings). No text is shuffled."""
    runs, items = phrase_matches(docs, benchmark)
    runs = materialize(runs, "runs")
    places = runs.select("id", "h", F.explode(F.sequence("first", F.col("first") + F.col("length") - 1)).alias("pos")).distinct()
    hit = places.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    names = broadcast_checked(items.select("item", "item_id").distinct(), 128)
    which = runs.select("id", "h", "item").distinct().join(names, "item").groupBy("id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = hit.join(which, hit["id"].eqNullSafe(which["id"]) & (hit["h"] == which["h"])).select(
        hit["id"].alias("hit_id"), hit["h"].alias("hit_h"), "n_hit", "items")
    rows = keyed(docs).select("id", "h", count_of(F.col("row.text"), TERM).alias("n_words"))
    joined = rows.join(both, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"))


def proximity_matches(index: DataFrame, items: DataFrame, within: int = 30) -> DataFrame:
    """(id, h, item, start, pos): all words of the item's window at ``start`` occur in the ``within`` words from ``pos``.

    ``pos`` holds one of them; order and repetitions do not matter. A window
    with a word that no document has matches nothing. ``index`` must hold the
    postings of all words of ``items``. An anchor looks at no more than the
    postings less than ``within`` words away.
    """
    windows = spread_windows(items, list_lengths(index)).groupBy("item", "start").agg(
        F.collect_set("term").alias("terms"), F.min_by("term", F.struct("cf", "term")).alias("term"), F.min("cf").alias("least"))
    windows = broadcast_checked(windows.where(F.col("least") > 0).drop("least"), 256)
    at = ["id", "h", "item", "start", "terms", "at"]
    anchors = index.join(windows, "term").select("id", "h", "item", "start", "terms", F.col("pos").alias("at")).distinct()
    block = lambda pos: F.floor(F.col(pos) / within)
    left = anchors.withColumn("block", F.explode(F.array(block("at") - 1, block("at"), block("at") + 1)))
    right = index.select(F.col("id").alias("its_id"), F.col("h").alias("its_h"), "pos", "term", block("pos").alias("its_block"))
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("h") == F.col("its_h")) & (F.col("block") == F.col("its_block"))
    near = left.join(right, same).where((F.abs(F.col("pos") - F.col("at")) < within) & F.array_contains("terms", F.col("term")))
    met = near.groupBy(*at).agg(F.collect_set(F.struct("pos", "term")).alias("met"))
    inside = lambda x: F.filter("met", lambda y: y["pos"].between(x["pos"], x["pos"] + within - 1))
    whole = lambda x: F.size(F.array_distinct(F.transform(inside(x), lambda y: y["term"]))) == F.size("terms")
    begins = F.filter("met", lambda x: (x["pos"] <= F.col("at")) & whole(x))
    return met.select("id", "h", "item", "start", F.explode(F.transform(begins, lambda x: x["pos"])).alias("pos")).distinct()


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs.

    The contaminated ids are a table whose size Spark sees: while it is small it
    goes to the texts, beyond that both are shuffled.
    """
    runs, _ = phrase_matches(docs, benchmark)
    hit = materialize(runs.select(F.col("id").alias("hit_id"), F.col("h").alias("hit_h")).distinct(), "contaminated")
    return keyed(docs).join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left_anti").select("row.*")
