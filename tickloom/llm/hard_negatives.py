"""Hard negatives by exact inner products, looked up in subset-sum tables.

Entries are whole numbers. A candidate is stored as its bit planes: for every
bit of its entries and every eight dimensions one byte says which of the eight
have that bit. An anchor has, for every eight dimensions, a table of the sums
of all 256 subsets of its entries. So one lookup gives what a plane adds in
eight dimensions; lookups are added over the dimensions, and planes from the
highest bit down by doubling, the sign's plane being taken off. The result is
the full inner product, exactly.

Anchors are taken in blocks of ``ANCHORS``, whose entries, a bounded size,
travel with the tasks, and every block meets every candidate: once to find the
anchors' positives, once for the negatives under each positive's score. A task
keeps the best few candidates per anchor, so what is shuffled does not depend
on the candidates it read. Every block's result is written before the next.

Defined cases: rows without label, or whose vector is null, empty or holds null
or non-finite entries, take no part. Ties go to the smaller id, null ids last;
a row without id is no anchor. Rows of an anchor's own id are never its
partners; other repeated rows count as often as they are there, and equal
anchors count once. Vectors of different lengths, entries beyond 2**44 and
scores that 2**56 does not bound raise. Without anchors there are no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.whitening import on_grid, usable
from tickloom.session import materialize

GRID = 256
ANCHORS = 1_024  # a block, which meets all candidates together
LANES, ROWS = 256, 1_024  # anchors and candidates that are scored at once
LAST = np.iinfo(np.int64).max  # stands for a null id, which comes last
NONE = np.iinfo(np.int64).min
PARTITION_BITS = 33  # of monotonically_increasing_id: rows within a partition


# --- scoring ---------------------------------------------------------------------------------


def groups_of_eight(values: np.ndarray) -> np.ndarray:
    """(rows x groups x 8), short groups filled with zeros."""
    rows, size = values.shape
    return np.pad(values, ((0, 0), (0, -size % 8))).reshape(rows, -1, 8)


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows x bits x groups) bytes of two's complement entries; the highest plane is the sign."""
    grouped = groups_of_eight(values)
    planes = [np.packbits((grouped >> b & 1).astype(np.uint8), axis=2, bitorder="little")[:, :, 0] for b in range(bits)]
    return np.stack(planes, axis=1)


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """(groups x 256 x anchors): sums of the entries that a byte's bits name."""
    grouped = groups_of_eight(anchors).astype(dtype)
    tables = np.zeros((grouped.shape[1], 256, len(anchors)), dtype)
    for k in range(8):
        tables[:, 1 << k:2 << k] = tables[:, :1 << k] + grouped[:, :, k].T[:, None, :]
    return tables


def inner_products(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(candidates x anchors) scores."""
    rows, bits, groups = planes.shape
    total, found = np.zeros((rows, tables.shape[2]), tables.dtype), np.empty((rows, tables.shape[2]), tables.dtype)
    for b in reversed(range(bits)):
        total <<= 1
        for g in range(groups):
            np.take(tables[g], planes[:, b, g], axis=0, out=found, mode="clip")
            if b == bits - 1:
                total -= found
            else:
                total += found
    return total


class Best:
    """The first ``keep`` candidates per slot by falling score, then rising id."""

    def __init__(self, keep: int):
        self.keep, self.held = keep, (np.zeros(0, np.int64),) * 3

    def offer(self, scores: np.ndarray, ids: np.ndarray, slot: int) -> None:
        """Scores (slots x candidates), of slots numbered from ``slot``; NONE is no candidate."""
        if scores.shape[1] > self.keep:
            least = np.partition(scores, -self.keep, axis=1)[:, -self.keep]
        else:
            least = np.full(len(scores), NONE)
        at, which = np.nonzero((scores >= least[:, None]) & (scores != NONE))
        found = (at + slot, scores[at, which], ids[which])
        slots, scores, ids = (np.concatenate(pair) for pair in zip(self.held, found, strict=True))
        order = np.lexsort((ids, -scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        self.held = tuple(column[place < self.keep] for column in (slots, scores, ids))


class Block:
    """A block of anchors: numbers, ids, labels and entries."""

    def __init__(self, rows: pa.Table, size: int, largest: int):
        self.numbers, self.ids, self.labels = (rows[c].to_numpy() for c in ("k", "id", "label"))
        self.values = np.array(rows["y"].to_pylist(), np.int64).reshape(-1, size)
        self.dtype = np.int32 if size * largest * largest < 1 << 30 else np.int64

    def scored(self, batches: Iterator[pa.RecordBatch], bits: int):
        """(first anchor, scores, ids, apart, same label) of candidates with groups of anchors; apart: not the anchor's own id."""
        lanes = [(a, subset_sums(self.values[a:a + LANES], self.dtype)) for a in range(0, len(self.values), LANES)]
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                ids = rows.column("id").fill_null(LAST).to_numpy()
                labels = rows.column("label").to_numpy()
                planes = np.frombuffer(b"".join(rows.column("planes").to_pylist()), np.uint8).reshape(len(ids), bits, -1)
                for a, tables in lanes:
                    scores = np.ascontiguousarray(inner_products(planes, tables).T).astype(np.int64)
                    mine = slice(a, a + scores.shape[0])
                    yield a, scores, ids, self.ids[mine, None] != ids, self.labels[mine, None] == labels


# --- Spark ---------------------------------------------------------------------------------------


def partners(slots, scores, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(slots, pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64(), mask=ids == LAST)], ["slot", "score", "other"])


def first_of(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` partners of each slot over all tasks."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def anchor_blocks(anchors: DataFrame, size: int) -> list[tuple[int, int]]:
    """Ranges of the anchors' numbers ``k`` with at most ``size`` anchors each.

    Numbers are dense within a partition, so one row per partition tells them.
    """
    partition = F.shiftright("k", PARTITION_BITS)
    spans = anchors.groupBy(partition.alias("p")).agg(F.min("k"), F.max("k")).orderBy("p").collect()
    found, held = [], 0
    for _, low, high in spans:
        while low <= high:
            if not held:
                found.append((low, low))
            last = min(high, low + size - held - 1)
            found[-1] = (found[-1][0], last)
            held = (held + last - low + 1) % size
            low = last + 1
    return found


def mine(vectors: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, grid: int = GRID) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` tells from the id which rows are anchors. An anchor's positives
    are its first rows of the same label; negatives of a positive have another
    label and a score from ``least`` to ``most`` percent of the positive's.
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    named = vectors.select(F.col(f"`{id}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(f"`{vector}`").alias("vector"),
                           F.coalesce(anchor & F.col(f"`{id}`").isNotNull(), F.lit(False)).alias("anchor"))
    rows = named.where(F.col("label").isNotNull() & usable(F.col("vector")))
    rows = rows.select("id", "label", "anchor", on_grid(F.col("vector"), grid).alias("y"))
    largest = F.max(F.array_max(F.transform("y", lambda c: F.abs(c))))
    count, shortest, size, largest = rows.agg(F.count(F.lit(1)), F.min(F.size("y")), F.max(F.size("y")), largest).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not count:
        return spark.createDataFrame([], schema)
    if shortest != size:
        raise ValueError(f"vectors of {shortest} and of {size} entries")
    if size * largest * largest >= 1 << 56:
        raise ValueError("scores may exceed 56 bits")
    bits = largest.bit_length() + 1

    def pack(batches):
        for batch in batches:
            values = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            planes = bit_planes(values, bits).reshape(batch.num_rows, -1)
            cuts = np.arange(0, planes.size + 1, planes.shape[1], dtype=np.int32)
            stored = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts), pa.py_buffer(planes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), stored], ["id", "label", "planes"])

    candidates = materialize(rows.select("id", "label", "y").mapInArrow(pack, "id bigint, label bigint, planes binary"), "negatives-planes")
    chosen = rows.where("anchor").select("id", "label", "y").distinct().withColumn("k", F.monotonically_increasing_id())
    chosen = materialize(chosen, "negatives-anchors")
    found = []
    for low, high in anchor_blocks(chosen, ANCHORS):
        mine_ = chosen.where(F.col("k").between(low, high))
        block = Block(mine_.toArrow(), size, largest)
        likes = _positives(candidates, block, bits, positives)
        found.append(materialize(_negatives(candidates, block, bits, likes, negatives, least, most), "negatives-found"))
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[frame._materialized_at for frame in found])


def _positives(candidates: DataFrame, block: Block, bits: int, keep: int) -> pa.Table:
    """(slot, score, other, rank) of the block's positives, at most ``keep`` an anchor; slots are places in the block."""
    def run(batches):
        best = Best(keep)
        for a, scores, ids, apart, same in block.scored(batches, bits):
            best.offer(np.where(apart & same, scores, NONE), ids, a)
        yield partners(*best.held)

    return first_of(candidates.mapInArrow(run, "slot bigint, score bigint, other bigint"), keep).toArrow()


def _negatives(candidates: DataFrame, block: Block, bits: int, likes: pa.Table, keep: int, least: int, most: int) -> DataFrame:
    """The block's part of the result. A slot is an anchor's place times the ranks, plus the positive's."""
    likes = likes.sort_by([("slot", "ascending"), ("rank", "ascending")])
    anchors, ranks, bounds = likes["slot"].to_numpy(), likes["rank"].to_numpy(), likes["score"].to_numpy()
    others = likes["other"].to_pylist()

    def run(batches):
        best = Best(keep)
        for a, scores, ids, apart, same in block.scored(batches, bits):
            first, last = np.searchsorted(anchors, [a, a + len(scores)])
            scores = np.where(apart & ~same, scores, NONE)
            for rank in np.unique(ranks[first:last]):
                at = np.flatnonzero(ranks[first:last] == rank) + first
                mine, bound = scores[anchors[at] - a], bounds[at, None]
                fits = (mine != NONE) & (least * bound <= 100 * np.maximum(mine, NONE // 128)) & (100 * np.maximum(mine, NONE // 128) <= most * bound)
                held = np.full((at[-1] - at[0] + 1, scores.shape[1]), NONE)
                held[at - at[0]] = np.where(fits, mine, NONE)
                best.offer(held, ids, at[0])
        yield partners(*best.held)

    found = first_of(candidates.mapInArrow(run, "slot bigint, score bigint, other bigint"), keep)
    named = candidates.sparkSession.createDataFrame(
        [(n, int(block.ids[a]), others[n], int(bounds[n])) for n, a in enumerate(anchors)],
        "slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    return found.join(F.broadcast(named), "slot").select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
