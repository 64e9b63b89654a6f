import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, copies long, z string, deviation int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "z", 4) for i, v in rows], SCHEMA).repartition(3)


def some_rows(count=300, size=12, seed=4):
    """Correlated vectors, every third one the same, and some that take no part."""
    draw = np.random.default_rng(seed)
    mix = draw.normal(size=(size, size))
    values = (draw.normal(size=(count, size)) @ mix * 0.2).astype(np.float32)
    values[::3] = values[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(values)]
    rows += [(None, rows[5][1]), (7, rows[5][1]), (7, rows[5][1])]
    bad = [(900, None), (901, []), (902, [None] + [0.0] * (size - 1)), (903, [math.nan] * size), (904, [math.inf] + [0.0] * (size - 1))]
    return rows, bad


def brute_force(rows, components, weights=None):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    fit = x if weights is None else np.array(sorted(set(map(tuple, x))), object)
    n, total = len(fit), fit.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    centred = (x * n - total).astype(float) / n
    of_fit = (fit * n - total).astype(float) / n
    covariance = of_fit.T @ of_fit / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    return n, deviation, centred @ directions / np.sqrt(values), values / np.trace(covariance)


@pytest.mark.parametrize("fit", ["rows", "distinct"])
def test_equals_brute_force(spark, fit):
    rows, bad = some_rows()
    found = whitening.whiten(vectors_of(spark, rows + bad), components=5, fit=fit).collect()
    n, deviation, whitened, explained = brute_force(rows, 5, None if fit == "rows" else 1)
    assert len(found) == 5 * len(rows) and {r.n for r in found} == {n}
    by_id = {}
    for r in found:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    signs = [math.copysign(1, by_id[1, c + 1][0].whitened * whitened[1, c]) for c in range(5)]
    for place, (i, _) in enumerate(rows):
        for c in range(5):
            mine = by_id[i, c + 1]
            wanted = whitened[place, c] * signs[c]
            assert any(math.isclose(r.whitened, wanted, rel_tol=1e-7, abs_tol=1e-9) and r.deviation == deviation[place] for r in mine)
            assert all(math.isclose(r.explained, explained[c], rel_tol=1e-9) for r in mine)
    assert len(by_id[7, 1]) == 3 and len(by_id[None, 1]) == 1
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


def test_a_third_of_the_rows_in_one_vector_is_whitened_once(spark):
    rows, _ = some_rows()
    found = whitening.whiten(vectors_of(spark, rows), components=2)
    same = found.where("vec_id % 3 = 0").groupBy("component").agg(F.countDistinct("whitened").alias("values"), F.count("*").alias("rows")).collect()
    assert [(r["values"], r["rows"]) for r in same] == [(1, 100)] * 2


def test_large_entries_are_summed_exactly():
    draw = np.random.default_rng(1)
    values, weights = draw.integers(-(1 << 44), 1 << 44, (20, 3)), draw.integers(1, 1 << 20, 20)
    exact = (values.astype(object) * weights.astype(object)[:, None]).T @ values.astype(object)
    assert (whitening.weighted_product(values, weights) == exact).all()
    small = values >> 36
    assert (whitening.weighted_product(small, weights) == (small.astype(object) * weights.astype(object)[:, None]).T @ small.astype(object)).all()
    assert list(whitening.weighted_sums(values, weights)) == list((values.astype(object) * weights.astype(object)[:, None]).sum(axis=0))


def test_nothing_to_whiten(spark):
    one = [(i, [0.5, 0.25]) for i in range(4)]
    for rows in ([], [(1, None)], one, one[:1]):
        found = whitening.whiten(vectors_of(spark, rows))
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert found.collect() == []
    line = whitening.whiten(vectors_of(spark, [(i, [i * 0.5, i * 1.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and math.isclose(line[0].explained, 1.0)


def test_odd_input_raises(spark):
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(vectors_of(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors_of(spark, [(1, [1e30, 1.0])]))
