"""The language, quality and language-model operators: held-out accuracy and defined cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import WORD, edge_texts, lowered, same_rows
from tickloom.llm import additive, context_mixing, languages
from tickloom.llm.kernels import Words, byte_tables, chunked

SF = "/root/testdata/sf0.01"


def crc(doc_id, parts):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_documents(documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = languages.identify(documents).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_language_of_edge_documents(edge_docs, no_docs):
    rows = languages.identify(edge_docs).collect()
    assert len(rows) == len(edge_texts())
    letters = Counter(any(c.isalpha() for c in t or "") for _, t, _ in edge_texts())
    assert Counter(r["lang_pred"] != "und" for r in rows) == letters
    assert languages.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in languages.predict(edge_docs, [], np.zeros((3, 1, 0))).collect()} == {"und"}


def test_mixture_of_two_languages():
    table = np.zeros((languages.ORDERS, 1 << languages.BUCKET_BITS, 2), np.float32) - 5
    points, _ = languages.code_points(["aaa bbb"])
    buckets = languages.gram_buckets(points)
    table[:, buckets[:, 0], 0] = table[:, buckets[:, 4], 1] = -0.1
    best, share = languages.mixtures(*languages.word_likelihoods(["a " * 30 + "b " * 10, "a " * 9, "", "b a " + "b " * 40], table), 4)
    assert best.tolist() == [0, 0, -1, 1] and abs(share[0] - 0.75) < 0.02 and share[1] == 1


def test_quality_of_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = additive.classify(documents, labels).collect()
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_of_edge_documents(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 1, 2) for i in range(30)] * 2 + [(0, None, 1, 2), (None, 1, 1, 2), (1, 7, 1, 2), (1, 1, 1, 2)], "doc_id long, quality int, h int, score int")
    rows = additive.classify(edge_docs, labels).collect()
    assert len(rows) == len(edge_texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert additive.classify(no_docs, labels).count() == 0
    assert {r["score"] for r in additive.classify(edge_docs, labels.where("false")).collect()} == {0.5}
    kept = additive.good_documents(edge_docs, labels)
    assert kept.columns == edge_docs.columns
    assert kept.count() == sum(r["predicted"] for r in rows)


def test_good_documents_shuffle_no_text(spark, documents):
    """Also where no table is small enough to broadcast for the filter."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wanted = Counter(r["doc_id"] for r in additive.classify(documents, labels).where("predicted = 1").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = additive.good_documents(documents, labels)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert 0 < sum(wanted.values()) < documents.count()
        assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_additive_model_needs_its_pairs():
    random = np.random.default_rng(5)
    values = random.normal(size=(4000, 4))
    labels = ((values[:, 0] > 0) ^ (values[:, 1] > 0)).astype(float)
    model = additive.AdditiveModel().fit(values[:3000], labels[:3000])
    assert (0, 1) in {(i, j) for i, j, _ in model.pairs}
    assert np.mean((model.score(values[3000:]) > 0.5) == labels[3000:]) > 0.9


def test_scores_against_brute_force(edge_docs, no_docs):
    rows = context_mixing.score(edge_docs).collect()
    counts = Counter()
    for doc_id, text, _ in edge_texts():
        if crc(doc_id, 7) != 2:
            counts.update([*WORD.findall(lowered(text)), None])
    total, distinct = sum(counts.values()), len(counts)
    wanted = []
    for doc_id, text, _ in edge_texts():
        tokens = [*WORD.findall(lowered(text)), None]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        wanted.append((doc_id, crc(doc_id, 7) == 2, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 4)))
    same_rows([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows], wanted)
    assert all(r["score"] < 0 for r in rows)
    assert context_mixing.score(no_docs).count() == 0


def test_bits_of_all_continuations_sum_to_one():
    words = [b"the", b"then", b"there", b"a", b"an"]
    data, offsets = context_mixing.joined_words(words)
    slots, bits, _ = context_mixing.bit_contexts(data, offsets)
    ones, total = [np.zeros(1 << b) for b in context_mixing.SLOT_BITS], [np.zeros(1 << b) for b in context_mixing.SLOT_BITS]
    for k in range(context_mixing.ORDERS):
        np.add.at(total[k], slots[k], 1)
        np.add.at(ones[k], slots[k], bits)
    model = context_mixing.Mixture(ones, total)
    # one byte and its closing space against the same byte alone: sum over all bytes of the first eight bits
    first = []
    for byte in range(256):
        slots, bits, places = context_mixing.bit_contexts(np.array([byte], np.uint8), np.array([0, 1]))
        odds, gate = model.features(slots, bits, places, 0)
        mix = (model.weights[gate].T * odds).sum(axis=0)
        first.append(np.exp(-np.logaddexp(0, np.where(bits == 1, -mix, mix)).sum()))
    assert abs(sum(first) - 1) < 1e-4
    assert model.log10([b"the"])[0] > model.log10([b"xqz"])[0]


def test_common_words_are_cheaper_than_rare(documents):
    rows = context_mixing.score(documents).where("held_out").collect()
    per_token = [r["score"] / r["n_tokens"] for r in rows if r["n_known"] > 0.95 * r["n_tokens"]]
    strange = [r["score"] / r["n_tokens"] for r in rows if r["n_known"] < 0.7 * r["n_tokens"]]
    assert np.mean(per_token) > np.mean(strange)


def test_scores_depend_on_the_order_of_words(spark):
    ordered = "the cat sat on the mat while the old dog slept under a big tree"
    shuffled = " ".join(sorted(ordered.split()))
    rows = [(i, ordered) for i in range(40)] + [(i, shuffled) for i in range(100, 101)]
    found = {r["doc_id"]: r for r in context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string"), folds=1).collect()}
    assert abs(found[0]["base_score"] - found[100]["base_score"]) < 1e-6
    assert found[0]["score"] > found[100]["score"] + 3


def test_closed_texts_and_their_contexts():
    texts = ["the  Cat", "", None, "cat sat\tdown"]
    ((_, _, data, offsets),) = chunked(pa.array(texts), 1 << 20)
    closed, bounds = context_mixing.closed_texts(Words(data, offsets, byte_tables()))
    assert [closed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [b"the cat \0", b"\0", b"\0", b"cat sat down \0"]
    contexts, place = context_mixing.byte_contexts(closed, bounds)
    first, second = bounds[0] + 4, bounds[3]  # "cat" after "the" and at a text's start
    assert place[first] == place[second] == 0
    same = contexts[:, first + 2] == contexts[:, second + 2]
    assert same.tolist() == [True, True, False, True, False, False]


def test_weights_are_fitted_on_all_training_texts(spark, monkeypatch):
    random = np.random.default_rng(3)
    names = ["".join(random.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts = [" ".join(names[j] for j in (random.random(60) ** 2 * 300).astype(int)) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("text").repartition(5)
    n_bytes = sum(map(len, texts))
    whole, _ = context_mixing.trained(frame, n_bytes)
    closed = context_mixing.closed_texts(Words(np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([*map(len, texts)])]), byte_tables()))
    gain = whole.step(whole.slopes(*closed))
    assert gain < 0.01 * n_bytes  # nothing left to learn from all texts
    monkeypatch.setattr(context_mixing, "START_BYTES", 1000)
    other, _ = context_mixing.trained(frame, n_bytes)
    a, b = whole.scores(*closed).sum(), other.scores(*closed).sum()
    assert abs(a - b) < 0.01 * abs(a)  # the start does not decide


def test_words_seen_once_are_counted_in_every_order(spark):
    frame = spark.createDataFrame([("zyxwv",), ("aa bb",)], "text string").repartition(2)
    tables = context_mixing.predictor_tables(frame).tables
    assert [len(table).bit_length() - 1 for table in tables] == list(context_mixing.SLOT_BITS)
    n_bits = 8 * len(b"zyxwv \0aa bb \0")
    assert [table[:, 1].sum() for table in tables] == [n_bits] * context_mixing.ORDERS


def drawn_texts(count, seed=3):
    random = np.random.default_rng(seed)
    names = ["".join(random.choice(list("abcdefgh"), size)) for size in random.integers(1, 14, 300)]
    return [" ".join(names[j] for j in (random.random(60) ** 2 * 300).astype(int)) for _ in range(count)]


def test_half_bytes_give_what_bits_give():
    """Nodes seen never, once and often, places up to the last, several texts."""
    ((_, _, data, offsets),) = chunked(pa.array([*drawn_texts(30), "", "\u00e4\u20ac " * 9, "x" * 40]), 1 << 20)
    data, offsets = context_mixing.closed_texts(Words(data, offsets, byte_tables()))
    slots, bits, places = context_mixing.bit_contexts(data[:offsets[20]], offsets[:21])
    ones, total = [np.zeros(1 << b) for b in context_mixing.SLOT_BITS], [np.zeros(1 << b) for b in context_mixing.SLOT_BITS]
    for k in range(context_mixing.ORDERS):
        np.add.at(total[k], slots[k], 1)
        np.add.at(ones[k], slots[k], bits)
    model = context_mixing.Mixture(ones, total)
    assert all((t[:, 0] == o).all() and (t[:, 1] == n).all() for t, o, n in zip(model.tables, ones, total, strict=True))
    model.weights = np.random.default_rng(1).normal(0.25, 0.1, model.weights.shape).astype(np.float32)
    slots, bits, places = context_mixing.bit_contexts(data, offsets)

    def mixes(left_out):
        odds, gate = model.features(slots, bits, places, left_out)
        return odds, gate, np.clip((model.weights[gate].T * odds).sum(axis=0), -20, 20)

    cost = np.logaddexp(0, np.where(bits == 1, -1, 1) * mixes(0)[2].astype(float)).reshape(8, -1).sum(axis=0)
    wanted = -np.add.reduceat(cost, offsets[:-1]) / np.log(10)
    assert np.allclose(model.scores(data, offsets), wanted, rtol=1e-5)
    odds, gate, mix = mixes(1)
    found = 1 / (1 + np.exp(-mix.astype(float)))
    slopes, uncurved = model.slopes(data, offsets), model.slopes(data, offsets, False)
    assert len(np.unique(gate)) > 20
    for g in range(context_mixing.GATES):
        x, error, spread = odds[:, gate == g].astype(float), (bits - found)[gate == g], (found * (1 - found))[gate == g]
        assert np.allclose(slopes[g, :, 0], x @ error, rtol=1e-3, atol=0.05)
        assert np.allclose(slopes[g, :, 1:], (x * spread) @ x.T, rtol=1e-3, atol=0.05)
    assert np.allclose(uncurved[:, :, 0], slopes[:, :, 0])
    assert not uncurved[context_mixing.TOP_GATES, :, 1:].any() and slopes[context_mixing.TOP_GATES, :, 1:].any()


@pytest.mark.parametrize("regular", [True, False])
def test_large_corpus_is_fitted_in_few_rounds(spark, monkeypatch, regular):
    """Growing shares give the start; nothing is left to gain, also where words that are known by heart slow the rounds down."""
    letters = "".join(np.random.default_rng(4).choice(list("etaoin "), 600_000))
    texts = [letters[at:at + 300] for at in range(0, len(letters), 300)] if not regular else drawn_texts(1500)
    n_bytes = sum(map(len, texts))
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    monkeypatch.setattr(context_mixing, "START_BYTES", n_bytes // 100)
    rounds, summed = [], context_mixing.summed_slopes
    monkeypatch.setattr(context_mixing, "summed_slopes", lambda rows, *more: rounds.append(rows is frame) or summed(rows, *more))
    whole, _ = context_mixing.trained(frame, n_bytes)
    assert regular or sum(rounds) <= 2
    ((_, _, data, offsets),) = chunked(pa.array(texts), 1 << 24)
    gain = whole.step(whole.slopes(*context_mixing.closed_texts(Words(data, offsets, byte_tables()))))
    assert gain < context_mixing.GAIN * math.log(2) * n_bytes


def test_words_are_found_in_their_buckets():
    random = np.random.default_rng(2)
    hashes = np.concatenate([random.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64), ~np.arange(40, dtype=np.uint64)])
    values = np.arange(len(hashes))
    first, keys, kept = context_mixing.bucketed(hashes.view(np.int64), values)
    at, known = context_mixing.looked_for(hashes, first, keys)
    assert known.all() and (kept[at] == values).all()
    assert not context_mixing.looked_for(hashes[:3000] + np.uint64(1), first, keys)[1].any()
    first, keys, kept = context_mixing.bucketed(np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, known = context_mixing.looked_for(hashes, first, keys)
    assert not known.any() and not kept[at].any()


def test_words_are_counted_over_batches(spark, monkeypatch):
    texts = [*drawn_texts(50), "held only here", None, ""]
    rows = [(n % 3 > 0, t) for n, t in enumerate(texts)]
    wanted = Counter({word: 0 for _, t in rows for word in WORD.findall(lowered(t))})
    for trains, t in rows:
        wanted.update(WORD.findall(lowered(t)) if trains else [])
    monkeypatch.setattr(context_mixing, "WORDS", 100)
    found = context_mixing.word_counts(spark.createDataFrame(rows, "trains boolean, text string").repartition(3)).collect()
    assert len({r["hash"] for r in found}) == len(found)
    assert Counter(r["c"] for r in found) == Counter(wanted.values())
