"""Language mixtures of documents by expectation maximisation over n-gram likelihoods.

The model holds, per language, smoothed counts of hashed character 1- to
3-grams within words. A word's log likelihood under a language is the mean over
the orders of its grams' log probabilities. A document is a mixture: EM finds the
proportions of its languages from its words' likelihoods. Of the sets of the k
largest languages, the one with the best likelihood less a penalty per language
wins; most documents are done after the first look, as the full mixture does
not gain a second language's penalty over the best single one. The predicted
language is the largest of the set, its proportion the score.

The classifier learns from a bounded sample of labelled rows (``TRAIN_ROWS`` per
language, drawn by rank of a hash; all rows where there are fewer).

Defined cases: null texts and texts without a letter are ``und`` with score 0; so
is everything without labelled rows. Rows with null language do not teach. Ties
go to the language that sorts first. Rows that repeat an id are separate.
Null ids are in fold 0 and so teach. No rows give no rows.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fold, packed
from tickloom.llm.kernels import CHUNK_BYTES

TRAIN_ROWS = 5000
BUCKET_BITS = 15
ORDERS = 3
EM_ROUNDS = 8
PENALTY = 6.0
SPACE = 32
LETTER = re.compile(r"[^\W\d_]")


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, a space after each, and where texts end."""
    lowered = [text.lower() + " " for text in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points, np.cumsum([len(text) for text in lowered])


def gram_buckets(points: np.ndarray) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams that end at each point."""
    one = points
    two = np.concatenate([[SPACE], points[:-1]])
    three = np.concatenate([[SPACE, SPACE], points[:-2]])[:len(points)]
    # a gram does not reach over a word's start
    three = np.where(two == SPACE, SPACE, three)
    out = np.empty((ORDERS, len(points)), np.int32)
    for k, grams in enumerate((one, one + two * 0x110000, one + two * 0x110000 + three * 0x10FFFF7)):
        mixed = (grams + k + 1) * 0x9E3779B97F4A7C1
        out[k] = ((mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B >> 20) & ((1 << BUCKET_BITS) - 1)
    return out


def pieces(texts: list[str], limit: int = CHUNK_BYTES // 2) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together."""
    first = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def word_likelihoods(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x languages) log likelihoods and each word's text, for words with a letter."""
    points, ends = code_points(texts)
    buckets = gram_buckets(points)
    solid = points > SPACE
    begin = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    if not len(begin):
        return np.zeros((0, table.shape[-1]), np.float32), np.zeros(0, np.int64)
    grams = table[0][buckets[0]] + table[1][buckets[1]] + table[2][buckets[2]]
    grams[~solid] = 0
    summed = np.add.reduceat(grams, begin, axis=0) / ORDERS
    letters = np.add.reduceat((points >= 97) & ~((points > 122) & (points < 170)), begin) > 0
    return summed[letters], np.searchsorted(ends, begin, side="right")[letters]


def mixtures(words: np.ndarray, of: np.ndarray, count: int, rounds: int = EM_ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(language, proportion) of each of ``count`` texts; -1 for texts without words."""
    languages = words.shape[1]
    best, share = np.full(count, -1, np.int64), np.zeros(count)
    if not len(words):
        return best, share
    texts, starts = np.unique(of, return_index=True)
    lengths = np.diff(np.concatenate([starts, [len(of)]]))
    rows = np.repeat(np.arange(len(texts)), lengths)
    peak = words.max(axis=1)
    chance = np.exp(words - peak[:, None])
    highest = np.add.reduceat(peak.astype(np.float64), starts)
    single = np.add.reduceat(words, starts, axis=0, dtype=np.float64)

    def em(chance, rows, starts, lengths, allowed):
        proportions = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            joint = chance * proportions[rows].astype(np.float32)
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
            proportions = np.add.reduceat(joint, starts, axis=0) / lengths[:, None]
        found = (chance * proportions[rows].astype(np.float32)).sum(axis=1)
        return proportions, np.add.reduceat(np.log(np.maximum(found, 1e-30)).astype(np.float64), starts)

    proportions, gained = em(chance, rows, starts, lengths, np.ones((len(texts), languages)))
    top = single.argmax(axis=1)
    value = single[np.arange(len(texts)), top] - penalty
    chosen, chosen_share = top.copy(), np.ones(len(texts))
    order = np.argsort(-proportions, axis=1, kind="stable")
    open_ = np.flatnonzero(gained + highest - 2 * penalty > value)
    for size in range(2, languages + 1):
        if not len(open_):
            break
        mine = np.isin(rows, open_)
        lengths_ = lengths[open_]
        starts_ = np.cumsum(lengths_) - lengths_
        allowed = np.zeros((len(open_), languages))
        np.put_along_axis(allowed, order[open_, :size], 1, axis=1)
        found, gain = em(chance[mine], np.repeat(np.arange(len(open_)), lengths_), starts_, lengths_, allowed)
        better = gain + highest[open_] - size * penalty > value[open_]
        at = open_[better]
        value[at] = (gain + highest[open_] - size * penalty)[better]
        chosen[at], chosen_share[at] = found[better].argmax(axis=1), found[better].max(axis=1)
        open_ = open_[gained[open_] + highest[open_] - (size + 1) * penalty > value[open_]]
    best[texts], share[texts] = chosen, chosen_share
    return best, share


# --- Spark ------------------------------------------------------------------------------


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, seed: int = 23) -> tuple[list[str], np.ndarray]:
    """The languages in order and their tables (orders x buckets x languages) of log probabilities."""
    totals = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    names = sorted(totals)
    if not names:
        return [], np.zeros((ORDERS, 1 << BUCKET_BITS, 0), np.float32)
    # a language's share of rows, by hash: about ``rows`` of each
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    limit = F.element_at(F.create_map(*[F.lit(x) for name in names for x in (name, rows / totals[name])]), F.col("lang"))
    sample = labelled.where(draw < limit).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), ORDERS, 1 << BUCKET_BITS), np.int64)
        number = {name: i for i, name in enumerate(names)}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").to_pylist(), strict=True):
                points, _ = code_points([text])
                buckets = gram_buckets(points)[:, points > SPACE]
                for k in range(ORDERS):
                    counts[number[lang], k] += np.bincount(buckets[k], minlength=1 << BUCKET_BITS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts.ravel()[some])], ["slot", "n"])

    found = sample.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(names) * ORDERS << BUCKET_BITS)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(len(names), ORDERS, -1) + 0.5
    table = np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)
    return names, np.ascontiguousarray(table.transpose(1, 2, 0))


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of (doc_id, text) rows."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                texts = [text or "" for text in some.column("text").to_pylist()]
                langs, scores = [], np.zeros(len(texts))
                for first, last in pieces(texts):
                    part = texts[first:last]
                    if names:
                        best, share = mixtures(*word_likelihoods(part, shared.value), len(part))
                    else:
                        best, share = np.full(len(part), -1), np.zeros(len(part))
                    for i, text in enumerate(part):
                        if not names or not LETTER.search(text):
                            langs.append("und")
                        elif best[i] < 0:  # letters outside the alphabets that words are looked for in
                            langs.append(names[0])
                            scores[first + i] = 1 / len(names)
                        else:
                            langs.append(names[best[i]])
                            scores[first + i] = min(1.0, float(share[i]))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1, rows: int = TRAIN_ROWS) -> DataFrame:
    """Every row's doc_id, held_out, lang_pred and score; learns from the other folds' languages."""
    all_ = packed(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.lang").alias("lang"))
    held_out = fold(F.col("doc_id"), folds) == held
    names, table = train(all_.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()), rows)
    return predict(all_, names, table).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
