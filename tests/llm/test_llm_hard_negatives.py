import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import same_rows
from tickloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, slot int, planes string, k int, score int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, l, "i", 1, "p", 2, 3) for i, v, l in rows], SCHEMA).repartition(3)


def brute_force(rows, positives=5, negatives=5, least=80, most=100):
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v], l) for i, v, l in rows
              if l is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for anchor in sorted({(i, tuple(y), l) for i, y, l in usable if i is not None and i % 10 == 0}):
        scored = [(-sum(a * b for a, b in zip(anchor[1], y)), i is None, i or 0, i, l) for i, y, l in usable if i != anchor[0]]
        for p in sorted(s for s in scored if s[4] == anchor[2])[:positives]:
            fits = sorted(s for s in scored if s[4] != anchor[2] and least * -p[0] <= 100 * -s[0] <= most * -p[0])
            out += [(anchor[0], p[3], rank, n[3], -p[0], -n[0]) for rank, n in enumerate(fits[:negatives], 1)]
    return out


def some_rows(size, seed, scale=1.0, count=150):
    draw = np.random.default_rng(seed)
    values = (draw.normal(size=(count, size)) * scale).astype(np.float32)
    values[::3] = values[0]  # a third of the rows is one vector: ties all over
    rows = [(int(i), [float(c) for c in v], int(draw.integers(3))) for i, v in enumerate(values)]
    rows += [rows[20], rows[20], (20, rows[21][1], 1), (None, rows[22][1], 0), (None, rows[23][1], 1), (7, rows[24][1], None)]
    return rows + [(30, None, 1), (40, [], 1), (50, [math.nan] * size, 0), (60, [None] * size, 0), (70, [math.inf] * size, 2), (-80, rows[25][1], 2)]


@pytest.mark.parametrize("size,scale", [(64, 0.1), (13, 0.1), (1, 3.0), (8, 40_000.0)])
def test_equals_brute_force(spark, monkeypatch, size, scale):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rows = some_rows(size, size, scale)
    found = hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0)
    same_rows(found.collect(), brute_force(rows))


def test_fewer_than_asked_for(spark):
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.1], 2)]
    found = hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 2, 65536, 230 * 256)]


def test_labels_may_be_made_up(spark):
    rows = some_rows(8, 3, 0.2)
    label = F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label"))
    found = hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0, label=label)
    moved = [(i, v, l + 1 if i is not None and i % 7 == 0 and l is not None else l) for i, v, l in rows]
    same_rows(found.collect(), brute_force(moved))


def test_no_rows(spark):
    for rows in ([], [(1, [1.0], 1)], [(10, None, 1)], [(10, [0.5], 1)]):
        found = hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0)
        assert found.collect() == [] and found.columns[:2] == ["anchor_id", "positive_id"]


@pytest.mark.parametrize("largest,dtype", [(300, np.int32), (1 << 20, np.int64)])
def test_lookups_add_up_to_products(largest, dtype):
    draw = np.random.default_rng(2)
    anchors, others = draw.integers(-largest, largest + 1, (5, 19)), draw.integers(-largest, largest + 1, (40, 19))
    others[0], others[1] = largest, -largest
    bits = largest.bit_length() + 1
    found = hard_negatives.inner_products(hard_negatives.bit_planes(others, bits), hard_negatives.subset_sums(anchors, dtype))
    assert (found == others @ anchors.T).all()


def test_odd_input_raises(spark):
    for rows, match in (([(1, [1.0], 1), (2, [1.0, 2.0], 1)], "entries"), ([(1, [1e7], 1), (2, [1.0], 1)], "56 bits")):
        with pytest.raises(ValueError, match=match):
            hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0)
