"""Embedding whitening by the covariance of distinct vectors, weighted by how often each occurs.

Vectors are put on an integer grid, so equal ones can be grouped: every later
step runs once per distinct vector, with its number of copies (or one) as
weight. First the weighted sums per dimension, then the weighted matrix
product of the vectors less a whole-numbered centre next to the mean. Both are
sums of whole numbers, so they are exact and do not depend on how the rows are
spread; what the centre is off the mean is taken out exactly before the one
division. The covariance is dimensions squared large whatever the rows, and
its eigenvectors are found on the driver. Each distinct vector is projected
once, and the rows get their values by a join on the vector. Vectors that make
up more than a thousandth of the rows, fewer than a thousand of them, are
broadcast for that, the others are shuffled, so no task holds a large group.

Defined cases: rows take no part whose vector is null, empty, or holds null or
non-finite entries. Repeated rows each count and each return. Null ids come
back as null. Vectors of different lengths, and entries beyond 2**46, raise.
Directions without variance, to double precision, have no component; a single
distinct vector therefore gives no rows, and neither does an empty table.
"""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialize

GRID, OFFSET = 64, 1_000_000
COMPONENTS = 32
HOT = 1_000  # a vector is hot beyond this part of the rows, so there are fewer hot ones than this
BLOCK = 8_192
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62
SUMS = "i int, j int, total decimal(38,0)"


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def on_grid(vector: Column, grid: int, offset: int = 0) -> Column:
    """Entries as whole numbers: ``floor(grid * c) + offset``; raises beyond 52 bits."""
    def entry(c):
        scaled = c.cast("double") * grid
        return F.when(F.abs(scaled) < float(1 << 52), F.floor(scaled) + offset).otherwise(F.raise_error(F.lit("entry too large for the grid")))
    return F.transform(vector, entry)


def blocks(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(vectors, weights, rows) of up to ``BLOCK`` rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(first, BLOCK)
            vectors = rows.column("x")
            values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
            weights = rows.column("copies").to_numpy() if weighted else np.ones(len(vectors), np.int64)
            yield values, weights, rows


def weighted_sums(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Exact sums per column."""
    if int(np.abs(values).max()) * int(weights.sum()) < EXACT_LONG:
        return (values * weights[:, None]).sum(axis=0)
    return (values.astype(object) * weights.astype(object)[:, None]).sum(axis=0)


def weighted_product(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Exact ``values' diag(weights) values``: a product of doubles where no sum can exceed their 53 bits."""
    if int(np.abs(values).max()) ** 2 * int(weights.sum()) < EXACT_DOUBLE:
        wide = values.astype(np.float64)
        return ((wide * weights[:, None]).T @ wide).astype(np.int64)
    wide = values.astype(object)
    return (wide * weights.astype(object)[:, None]).T @ wide


def add(total, part):
    return part.astype(object) if total is None else total + part


def sum_rows(i, j, totals) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(t)) for t in totals], pa.decimal128(38, 0))],
        ["i", "j", "total"])


def matrix_of(sums: DataFrame, rows: int, columns: int) -> list[list[int]]:
    """The added-up sums, of a size that the dimensions fix, as Python integers."""
    out = [[0] * columns for _ in range(rows)]
    for i, j, total in sums.groupBy("i", "j").agg(F.sum("total")).collect():
        out[i][j] = int(total)
    return out


def covariance(distinct: DataFrame, size: int, n: int, sums: list[int], weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, whole-numbered centre) of the fit list, each entry rounded once."""
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def run(batches):
        total = None
        for values, weights, _ in blocks(batches, weighted):
            total = add(total, weighted_product(values - centre, weights))
        if total is not None:
            i, j = np.triu_indices(size)
            yield sum_rows(i, j, total[i, j])

    products = matrix_of(distinct.mapInArrow(run, SUMS), size, size)
    off = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = (n * products[i][j] - off[i] * off[j]) / (n * n)
    return out, centre


def principal(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) by falling value, without those that are zero to double precision.

    The entry of a vector that is largest in absolute value is positive.
    """
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    some = values > max(values[0], 0) * len(matrix) * np.finfo(float).eps
    values, vectors = values[some], vectors[:, some]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[largest, np.arange(len(values))])


def project(distinct: DataFrame, n: int, sums: list[int], centre: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(x, copies, deviation, z) per distinct vector."""
    off = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], object)
    scaled = vectors / np.sqrt(values)

    def run(batches):
        for x, _, rows in blocks(batches, True):
            moved = x - centre
            if n * (int(np.abs(moved).max()) + 1) < EXACT_LONG:
                apart = moved * np.int64(n) - off.astype(np.int64)
            else:
                apart = moved.astype(object) * n - off
            if int(np.abs(apart).max()) ** 2 * apart.shape[1] < EXACT_LONG:
                deviation = pa.array((apart * apart).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(int(d)) for d in (apart.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))
            z = (apart.astype(np.float64) / n) @ scaled
            cuts = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("x"), rows.column("copies"), deviation, pa.ListArray.from_arrays(cuts, z.ravel())],
                ["x", "copies", "deviation", "z"])

    return distinct.mapInArrow(run, "x array<bigint>, copies bigint, deviation decimal(38,0), z array<double>")


def identity_error(projected: DataFrame, count: int, n: int, weighted: bool) -> float:
    """Largest absolute entry of the projected vectors' covariance less the identity."""
    def added(of):
        def run(batches):
            total = None
            for batch in batches:
                z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                weights = batch.column("copies").to_numpy() if weighted else np.ones(batch.num_rows)
                part = of(z, weights)
                total = part if total is None else total + part
            if total is not None:
                i, j = np.indices(total.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])

        out = np.zeros((count, count))
        found = projected.select("copies", "z").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total"))
        for i, j, total in found.collect():
            out[i, j] = total
        return out

    mean = added(lambda z, w: (z * w[:, None]).sum(axis=0)[None, :])[0] / n
    found = added(lambda z, w: ((z - mean) * w[:, None]).T @ (z - mean)) / n
    return float(np.abs(found - np.eye(count)).max())


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           fit: str = "rows", grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    ``fit="rows"`` weights each distinct vector by its rows, ``fit="distinct"``
    by one. ``n`` is the length of the fit list, ``deviation`` the exact squared
    distance from its mean, times n squared; ``explained`` a component's part of
    all variance; ``identity_error`` one value for all rows.
    """
    if fit not in ("rows", "distinct"):
        raise ValueError(f"unknown fit {fit!r}")
    spark, weighted = vectors.sparkSession, fit == "rows"
    source = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = source.where(usable(F.col("vector"))).select("id", on_grid(F.col("vector"), grid, offset).alias("x"))
    distinct = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "whitening-distinct")
    count, copies, shortest, size = distinct.agg(
        F.count(F.lit(1)), F.sum("copies"), F.min(F.size("x")), F.max(F.size("x"))).first()
    schema = f"`{id}` {source.schema['id'].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not count:
        return spark.createDataFrame([], schema)
    if shortest != size:
        raise ValueError(f"vectors of {shortest} and of {size} entries")
    n = copies if weighted else count

    def add_up(batches):
        total = None
        for values, weights, _ in blocks(batches, weighted):
            total = add(total, weighted_sums(values, weights))
        if total is not None:
            yield sum_rows(np.zeros(size, int), np.arange(size), total)

    sums = matrix_of(distinct.mapInArrow(add_up, SUMS), 1, size)[0]
    matrix, centre = covariance(distinct, size, n, sums, weighted)
    values, directions = principal(matrix, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    projected = materialize(project(distinct, n, sums, centre, values, directions), "whitening-projected")
    error = identity_error(projected, len(values), n, weighted)

    hot = F.col("copies") * HOT > copies
    few = F.broadcast(projected.where(hot).select("x", "deviation", "z"))
    common = rows.join(few, "x")
    others = rows.join(F.broadcast(projected.where(hot).select("x")), "x", "left_anti")
    others = others.join(projected.where(~hot).select("x", "deviation", "z"), "x")
    whole = common.unionByName(others).select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(share)) for share in values / np.trace(matrix)])
    return whole.select(
        F.col("id").alias(id), (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
