"""Inverted lists lose no pair, whatever the threshold."""

import numpy as np
import pytest

from newsloom.operators import metric_index
from newsloom.operators.metric_index import MetricIndex


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.2, 0.6], (n, 1))
    return x * rng.uniform(0.1, 30, (n, 1))


def brute(rows, threshold):
    u = {i: v / np.linalg.norm(v) for i, v in rows}
    ids = sorted(u)
    m = np.array([u[i] for i in ids])
    near = np.triu(m @ m.T >= threshold, 1)
    return {(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))}


@pytest.mark.parametrize("lists", [1, 7, None])
def test_equals_all_pairs(spark, lists):
    rows = list(enumerate(clustered(900, 16, 1)))
    index = MetricIndex(spark.createDataFrame([(i * 3, v.tolist()) for i, v in rows], "id long, v array<double>").repartition(5), lists)
    for threshold in (0.98, 0.9, 0.5, -0.2):
        got = [(r.a, r.b) for r in index.pairs(threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == {(3 * a, 3 * b) for a, b in brute(rows, threshold)}


def test_copies_are_one_class(spark):
    rows = [(k, [1.0, 0.0, 0.5]) for k in range(40)] + [(100, [1.0, 0.01, 0.5]), (101, [-1.0, 0.0, 0.0])]
    odd = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [float("nan"), 1.0, 0.0]), (203, [1.0, 0.0]), (204, [None, 1.0, 0.0]), (205, [])]
    index = MetricIndex(spark.createDataFrame(rows + odd, "id long, v array<double>"))
    assert [(r.a, r.b) for r in index.pairs(0.9).collect()] == [(0, 100)]
    assert {(r.id, r.least) for r in index.members().collect()} == {(k, 0) for k in range(40)} | {(100, 100), (101, 101)}
    assert MetricIndex(spark.createDataFrame(odd[:2], "id long, v array<double>")).pairs(0.5).count() == 0


def test_a_high_threshold_visits_few_lists(spark):
    rows = clustered(3000, 24, 2)
    index = MetricIndex(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>"))
    assert index.lists == 27
    angle = metric_index._angle((rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ index.pivots.T)
    own = angle.argmin(1)
    radius = np.array([angle[own == k, k].max(initial=-np.inf) for k in range(index.lists)])
    visits = {t: (angle <= radius + np.arccos(t)).mean() for t in (0.99, 0.3)}
    assert visits[0.99] < visits[0.3]


def test_lists_that_spare_no_visits_are_few(spark):
    rows = np.random.default_rng(7).normal(size=(5000, 8))
    index = MetricIndex(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>"))
    assert index.lists == 35
    got = {(r.a, r.b) for r in index.pairs(0.9).collect()}
    assert index.lists == 2 * spark.sparkContext.defaultParallelism < 35
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))
