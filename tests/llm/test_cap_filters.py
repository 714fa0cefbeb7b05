import numpy as np
from pyspark.sql import Row

from newsloom.llm import cap_filters
from newsloom.llm.common import documents


def brute(rows):
    """vec_id -> (links, component) by all pairs of a label."""
    links, parent = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for label in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == label and label is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
        for d in {len(r[1]) for r in mine}:
            same = [r for r in mine if len(r[1]) == d]
            x = np.array([r[1] for r in same], float)
            n = np.linalg.norm(x, axis=1)
            near = (x @ x.T) / np.outer(n, n) >= 0.98
            for i in range(len(same)):
                for j in np.flatnonzero(near[i, :i]):
                    a, b = same[i][0], same[j][0]
                    links[a] += 1
                    links[b] += 1
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: (links[i], root(i)) for i in links}


def clusters(seed, dim, n=40, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        center = rng.normal(size=dim)
        for k in range(rng.integers(1, 12)):
            v = center + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.13, 0.2])
            rows.append((len(rows), [float(np.float32(t)) for t in v * rng.choice([1, 2])], int(rng.integers(labels))))
    return rows


def check(spark, rows, least=1.0):
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_vectors(spark.createDataFrame([Row(vec_id=i, embedding=v, label=k, node=1) for i, v, k in rows], "vec_id long, embedding array<float>, label int, node int")).collect()}
    expect = brute(rows)
    assert sum(n for n, _ in expect.values()) > 100
    assert sum(n for n, _ in got.values()) >= least * sum(n for n, _ in expect.values())
    assert all(got[i][0] <= expect[i][0] for i in got)
    if least == 1:
        assert got == expect


def test_links_match_all_pairs(spark):
    check(spark, clusters(1, 64))
    check(spark, clusters(2, 5), least=0.98)
    check(spark, clusters(4, 24), least=0.98)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "TILE", 3)
    check(spark, clusters(3, 16, n=25))


def test_documents_recall(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in documents(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    got = {r.vec_id: r.n_links for r in cap_filters.query(spark, "/root/testdata/sf0.1").collect()}
    expect = brute(rows)
    assert set(got) == set(expect)
    assert sum(got.values()) >= 0.99 * sum(n for n, _ in expect.values())
    assert all(got[i] <= expect[i][0] for i in got)


def test_lists_are_the_caps():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = 7
    rotation, words, parts = cap_filters.code(12, m)
    scores = [(x @ rotation)[:, p] @ w.T for p, w in zip(parts, words, strict=True)]
    every = sum(s.reshape(20, *[m if i == k else 1 for i in range(len(parts))]) for k, s in enumerate(scores)).reshape(20, -1)
    for row, caps in zip(every, cap_filters.decode(x, m), strict=True):
        above = np.flatnonzero(row >= cap_filters.cap_height(12, m))
        assert len(caps) >= cap_filters.LIST_LEAST
        assert set(above) <= set(caps.tolist()) or len(above) < cap_filters.LIST_LEAST
        assert row[caps].min() >= np.sort(row)[-len(caps)] - 1e-12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [1.0, inf], 1), (6, [1.0, None], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], None), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0, 0.0], 1), (12, [1.0, 2.0], 2), (None, [1.0, 2.0], 1), (9, [1.0, 2.0], 1)]
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, label=k) for i, v, k in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in cap_filters.near_vectors(df).collect())
    assert got == sorted([(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 8, 11, 12)] + [(9, 3, 9, True)] * 2 + [(10, 3, 9, False), (0, 3, 9, False)])
    assert cap_filters.near_vectors(df.limit(0)).count() == 0
