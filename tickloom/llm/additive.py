"""Quality classifier: a generalised additive model with pairwise interactions.

A document is described by a few shares and lengths. Each is cut into bins by
quantiles, and the model is a table of contributions per bin, plus tables for
some pairs of features. Training is cyclic boosting: every round visits each
feature and adds a tree of three leaves, fitted to the current gradient, to
the feature's table with a small rate. Pairs are chosen by how much a table of
two by two cuts explains of what is left, then boosted in turn in the same
way. A score adds the bins' contributions and squashes the sum.

The classifier learns from at most about ``TRAIN_ROWS`` labelled rows, drawn by
hash; all where there are fewer.

Defined cases: null and empty texts have features 0 and are scored like any
other. Rows without a 0/1 label do not teach; an id with several labels teaches
with each. Without labelled rows every score is 0.5. Null ids are in fold 0,
held out. Rows that repeat an id are separate. No rows give no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fold, packed
from tickloom.llm.kernels import Words, byte_tables, chunked, powers
from tickloom.session import materialize

TRAIN_ROWS = 30_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 80, 0.15
THRESHOLD = 0.3
FEATURES = (
    "log_words", "mean_length", "spread_length", "capitals", "digits", "symbols", "bangs", "points", "other_marks",
    "beyond_ascii", "line_feeds", "different_words", "next_same", "most_common", "different_pairs", "long_words",
)


# --- features ----------------------------------------------------------------------------


def byte_classes() -> list[np.ndarray]:
    """One table per counted class of bytes."""
    tables = []
    for members in (range(65, 91), range(48, 58), b"#*$%&|<>", b"!", b".,", b"\"'()-/:;=?@[]_{}~^`+\\", range(128, 256), b"\n"):
        table = np.zeros(256, bool)
        table[list(members)] = True
        tables.append(table)
    return tables


def features_of(texts: pa.Array, tables) -> np.ndarray:
    """(texts x features)."""
    spaces, up, classes = tables
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for first, last, data, offsets in chunked(texts):
        found = Words(data, offsets, spaces)
        bounds, hashes = found.bounds, found.hashes(up)
        lengths = (found.ends - found.starts).astype(np.float64)
        n = np.diff(bounds).astype(np.float64)
        size = np.maximum(np.diff(offsets), 1).astype(np.float64)

        def totals(values, cuts):
            running = np.concatenate([[0], np.cumsum(values)])
            return running[cuts[1:]] - running[cuts[:-1]]

        some = np.maximum(n, 1)
        mean = totals(lengths, bounds) / some
        columns = [np.log1p(n), mean, np.sqrt(np.maximum(totals(lengths * lengths, bounds) / some - mean * mean, 0))]
        columns += [totals(table[data], offsets) / size for table in classes]
        of = found.of()
        same = np.concatenate([hashes[1:] == hashes[:-1], [False]]) & np.concatenate([of[1:] == of[:-1], [False]]) if len(of) else np.zeros(0, bool)

        def distinct(values):
            """How many values each text has, and how often its most common one stands."""
            order = np.lexsort((values, of))
            new = np.ones(len(of), bool)
            new[1:] = (values[order][1:] != values[order][:-1]) | (of[order][1:] != of[order][:-1])
            runs = np.flatnonzero(new)
            most = np.zeros(last - first)
            np.maximum.at(most, of[order][runs], np.diff(np.concatenate([runs, [len(of)]])))
            return totals(new, bounds), most

        different, most = distinct(hashes)
        pairs = hashes * np.uint64(3) + np.concatenate([hashes[1:], hashes[:1]]) if len(hashes) else hashes
        columns += [different / some, totals(same, bounds) / some, most / some, distinct(pairs)[0] / some, totals(lengths > 15, bounds) / some]
        out[first:last] = np.stack(columns, axis=1)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, h, values) of (doc_id, h, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = byte_tables(), powers(1 << 20), byte_classes()
        for batch in batches:
            values = features_of(batch.column("text"), tables)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), rows], ["doc_id", "h", "values"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, values array<float>")


# --- the model -----------------------------------------------------------------------------


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(edge, values[:, i], side="right") for i, edge in enumerate(edges)], axis=1)


def tree_of_three(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The step per bin: the best two cuts of the bins, found one after the other."""

    def cut(low, high):
        g, w = np.cumsum(gradient[low:high]), np.cumsum(weight[low:high])
        if len(g) < 2 or w[-1] <= 0:
            return 0.0, None
        left, right = g[:-1] ** 2 / (w[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1)
        gain = left + right - g[-1] ** 2 / (w[-1] + 1)
        return gain.max(), low + int(gain.argmax()) + 1

    parts = [(0, len(gradient))]
    for _ in range(2):
        gains = [cut(*part) for part in parts]
        best = max(range(len(parts)), key=lambda i: gains[i][0])
        if gains[best][1] is None or gains[best][0] <= 1e-9:
            break
        low, high = parts.pop(best)
        parts += [(low, gains[best][1]), (gains[best][1], high)]
    step = np.zeros(len(gradient))
    for low, high in parts:
        step[low:high] = gradient[low:high].sum() / (weight[low:high].sum() + 1)
    return step


class AdditiveModel:
    """Tables per feature and per pair of features."""

    def __init__(self):
        self.base, self.edges, self.tables = 0.0, [], []
        self.pair_edges, self.pairs = [], []

    def fit(self, values: np.ndarray, labels: np.ndarray) -> "AdditiveModel":
        if not len(labels):
            return self
        inner = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(values[:, i], inner)) for i in range(values.shape[1])]
        coarse = np.linspace(0, 1, PAIR_BINS + 1)[1:-1]
        self.pair_edges = [np.unique(np.quantile(values[:, i], coarse)) for i in range(values.shape[1])]
        rate = (labels.sum() + 0.5) / (len(labels) + 1)
        self.base = float(np.log(rate / (1 - rate)))
        bins = binned(values, self.edges)
        self.tables = [np.zeros(len(edge) + 1) for edge in self.edges]
        total = np.full(len(labels), self.base)
        for _ in range(ROUNDS):
            for i, table in enumerate(self.tables):
                self._boost(table, bins[:, i], labels, total)
        cells = binned(values, self.pair_edges)
        self.pairs = [(i, j, np.zeros((len(self.pair_edges[i]) + 1) * (len(self.pair_edges[j]) + 1))) for i, j in self._chosen(cells, labels - squash(total))]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                self._boost(table, self._cell(cells, i, j), labels, total, self._quarters(i, j))
        return self

    def _boost(self, table, bins, labels, total, quarters=None):
        chance = squash(total)
        gradient = np.bincount(bins, labels - chance, len(table))
        weight = np.bincount(bins, chance * (1 - chance), len(table))
        step = RATE * (tree_of_three(gradient, weight) if quarters is None else self._pair_tree(gradient, weight, quarters))
        table += step
        total += step[bins]

    def _cell(self, cells, i, j):
        return cells[:, i] * (len(self.pair_edges[j]) + 1) + cells[:, j]

    def _quarters(self, i, j):
        """For each cut of both features, the quarter of every cell."""
        a, b = len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1
        rows, columns = np.divmod(np.arange(a * b), b)
        return [(rows >= x) * 2 + (columns >= y) for x in range(1, a) for y in range(1, b)]

    @staticmethod
    def _pair_tree(gradient, weight, quarters):
        best, step = 0.0, np.zeros(len(gradient))
        for quarter in quarters:
            g, w = np.bincount(quarter, gradient, 4), np.bincount(quarter, weight, 4)
            gain = (g * g / (w + 1)).sum()
            if gain > best:
                best, step = gain, (g / (w + 1))[quarter]
        return step

    def _chosen(self, cells, left):
        found = []
        for i in range(cells.shape[1]):
            for j in range(i + 1, cells.shape[1]):
                cell = self._cell(cells, i, j)
                g, n = np.bincount(cell, left), np.bincount(cell)
                found.append((-(g * g / (n + 1)).sum(), i, j))
        return [(i, j) for _, i, j in sorted(found)[:PAIRS]]

    def score(self, values: np.ndarray) -> np.ndarray:
        """Chances of label 1: additions of looked-up bins."""
        total = np.full(len(values), self.base)
        if self.edges:
            bins = binned(values, self.edges)
            for i, table in enumerate(self.tables):
                total += table[bins[:, i]]
            cells = binned(values, self.pair_edges)
            for i, j, table in self.pairs:
                total += table[self._cell(cells, i, j)]
        return squash(total)


# --- Spark -----------------------------------------------------------------------------------


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) of the rows; h is the text's hash."""
    return packed(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("h"), F.col("row.text").alias("text"))


def drawn_labels(labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS, seed: int = 31) -> DataFrame:
    """(id, label) of about ``rows`` labelled rows outside the held-out fold; all where there are fewer."""
    marked = packed(labels).select(F.col("row.doc_id").cast("long").alias("id"), F.col(f"row.{label}").cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold(F.col("id"), folds) != held))
    share = min(1.0, rows / max(marked.count(), 1))
    return marked.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).distinct()


def taught_model(described: DataFrame, drawn: DataFrame) -> AdditiveModel:
    """The model of the drawn rows among those described."""
    taught = described.join(drawn, described["doc_id"] == drawn["id"]).select("doc_id", "h", "values", "label").toArrow()
    taught = taught.sort_by([("doc_id", "ascending"), ("h", "ascending"), ("label", "ascending")])
    values = np.array(taught["values"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(values, taught["label"].to_numpy().astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Every row's doc_id, h (its text's hash), held_out, score and predicted; learns labels outside the held-out fold."""
    described = materialize(describe(keyed_texts(docs)), "quality-features")
    model = taught_model(described, drawn_labels(labels, folds=folds, held=held, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(model.score(flat.astype(np.float64)))], ["doc_id", "h", "score"])

    scored = described.mapInArrow(run, "doc_id long, h long, score double")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", "h", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", predicted)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` without those predicted 0.

    Only the texts that teach are described first. The others are described where they are scored, so that no text is shuffled.
    """
    drawn = materialize(drawn_labels(labels, **options), "quality-drawn")  # few and of known size, for Spark to broadcast
    model = taught_model(describe(keyed_texts(docs).join(drawn.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi")), drawn)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = byte_tables(), powers(1 << 20), byte_classes()
        for texts in batches:
            yield pa.array(model.score(features_of(texts, tables).astype(np.float64)))

    score = F.arrow_udf(run, "double")
    return packed(docs).where(score("row.text") >= threshold).select("row.*")
