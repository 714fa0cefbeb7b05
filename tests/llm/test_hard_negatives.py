import math

import numpy as np
import pytest

from newsloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, node string, score double, q int, part int"


def brute(rows):
    """By definition, with Python's integers. rows: (vec_id, vector, label)."""
    points = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        points.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    last = float("inf")
    for a, (aid, al, aq) in enumerate(points):
        if aid is None or aid % 100:
            continue
        scored = sorted((-min(max(sum(x * y for x, y in zip(aq, q)), -(2**63)), 2**63 - 1), last if i is None else i, k) for k, (i, _, q) in enumerate(points) if k != a and len(q) == len(aq))
        near = [s for s in scored if points[s[2]][1] == al][:5]
        far = [(s, i, k) for s, i, k in scored if points[k][1] != al]
        for p, _, k in near:
            hits = [(s, j) for s, _, j in far if 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(aid, points[k][0], n + 1, points[j][0], -p, -s) for n, (s, j) in enumerate(hits)]
    return sorted(out, key=str)


def run(spark, rows):
    full = [(i, None if v is None else list(map(lambda x: None if x is None else float(x), v)), lab, "x", 0.5, 3, 7) for i, v, lab in rows]
    got = H.hard_negatives(spark.createDataFrame(full, SCHEMA).repartition(3))
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(n, dim, seed, spectrum=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * spectrum ** np.arange(dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(k, x[k], int(rng.integers(0, 10))) for k in range(n)]


def test_equals_brute_force_with_odd_rows(spark):
    rows = made(700, 24, 1)
    rows += [(i, v, (lab + 1) % 3) for i, v, lab in rows[:40]]  # repeated ids, another label
    rows += [(5000 + k, rows[100][1], 3) for k in range(60)]  # copies of an anchor: ties
    rows += [(6000, None, 1), (6100, rows[0][1], None), (6200, [0.1, None] + [0.0] * 22, 1), (6300, [float("nan")] + [0.0] * 23, 2), (6400, [float("inf")] + [0.0] * 23, 2), (6500, [1e307] + [0.0] * 23, 2)]
    rows += [(None, rows[3][1], 4), (None, rows[100][1], 3)]
    rows += [(7000, [], 1), (7001, [], 1), (7002, [], 2), (7100, [0.5, 0.5], 1), (7101, [0.5, 0.25], 1), (7102, [0.25, 0.25], 4)]
    assert run(spark, rows) == brute(rows)


def test_huge_components(spark):
    rows = [(100 * k, np.array([1.0, 2.0 ** (3 * k)]) * 2.0 ** (k % 5), k % 3) for k in range(1, 12)] + [(k, [1e18 * (k % 4), 3.0], k % 3) for k in range(1, 30)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None), (100, [1.0], 1)]) == []


@pytest.mark.parametrize("spectrum", [1.0, 0.8])
def test_several_parts_and_tiles(spark, spectrum):
    rows = made(2 * H.TILE + 500, 32, 2, spectrum)
    assert run(spark, rows) == brute(rows)


def test_leading_components_discard():
    x = np.floor(np.array([v for _, v, _ in made(4000, 64, 3, 0.85)]) * 256)
    m = x.T @ x
    turn = np.linalg.eigh(m)[1][:, ::-1]
    a, b = H.Rotated(x[:50], turn), H.Rotated(x, turn)
    exact = x[:50] @ x.T
    low = np.sort(exact, axis=1)[:, -6]
    high = np.full(50, np.inf)
    seen = []
    einsum = np.einsum
    try:
        np.einsum = lambda *args: (seen.append(len(args[1])), einsum(*args))[1]
        i, j, s, _ = H.surviving(a, b, low, high, np.ones((50, 4000), bool))
    finally:
        np.einsum = einsum
    assert set(zip(*np.nonzero(exact >= low[:, None]))) <= set(zip(i, j)) and len(i) <= 400
    assert np.abs(s - exact[i, j]).max() < 1e-3 and seen and max(seen) < 50 * 4000 / 8


def test_no_product_is_lost_to_rounding():
    rng = np.random.default_rng(5)
    x = rng.integers(-256, 257, size=(300, 16)).astype(float)
    turn = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    a, b = H.Rotated(x[:40], turn), H.Rotated(x, turn)
    exact = x[:40] @ x.T
    for k in range(0, 300, 7):  # the interval is a single score: the bound and the product meet
        i, j, _, _ = H.surviving(a, b, exact[:, k], exact[:, k], np.ones((40, 300), bool))
        assert {(n, k) for n in range(40)} <= set(zip(i.tolist(), j.tolist()))
