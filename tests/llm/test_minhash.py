import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from newsloom.llm import minhash
from newsloom.llm.common import documents
from newsloom.llm.components import components


def brute_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def brute(rows, width, percent):
    """doc_id -> (n, component) by all pairs."""
    sets = {i: brute_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(sets, key=lambda i: len(sets[i]))
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * len(x) < percent * len(y):
                break
            both = len(x & y)
            if x and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows) * 3 % 1009 + g * 2000, " ".join(words)))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_made_near_copies_match_all_pairs(spark, width):
    rows = near_copies(40)
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width, 80).collect()}
    assert got == brute(rows, width, 80)


def test_documents_match_all_pairs(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.query(spark, "/root/testdata/sf0.01").collect()}
    expect = brute([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    assert got == {i: (n, c, i == c) for i, (n, c) in expect.items()}


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    for j in (0.0, 0.5, 0.8, 1.0):
        n, errors = 400, []
        for _ in range(30):
            both = int(round(2 * n * j / (1 + j)))
            x = rng.integers(0, 1 << 54, 2 * n - both).astype(np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[n - both :])
            _, _, sig = minhash.sketch(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            words = sig.view(np.uint64)
            errors.append(minhash.similarity(words[0], words[1], minhash.PERMUTATIONS) - j)
        assert abs(np.mean(errors)) < 0.03


def test_sets():
    texts = ["", " \n", "One", "a B a b a b", None, "é É x"]
    values, edges = minhash.shingle_sets(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), 2)
    assert np.diff(edges).tolist() == [0, 0, 1, 2, 0, 2]
    assert len(set(values.tolist())) == 5


def test_proposals_skip_refuted_and_own_component():
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 1 << 54, 500).astype(np.uint64))
    sets = [base, base[:-20], base[20:], base[:-30]]
    sigs = [minhash.sketch(s, np.array([0, len(s)]))[2].view(np.uint64)[0] for s in sets]
    nodes, comps = np.array([1, 2, 3, 4]), np.array([1, 1, 3, 3])
    find = lambda no, **how: [nodes[x] for x in minhash.propose(nodes, comps, np.array(sigs), no, np.full(4, 3), 0.6, minhash.PERMUTATIONS, 0.8, **how)[:2]]
    a, b = find([None] * 4)
    cross = {(1, 3), (1, 4), (2, 3), (2, 4)}
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} <= cross and set(a.tolist()) == {1, 2, 3, 4}
    a, b = find([None] * 4, top=100, every=True)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == cross
    assert all(len(find([[3, 4], [3, 4], [1, 2], [1, 2]], every=e)[0]) == 0 for e in (False, True))


def test_large_buckets_are_searched_in_rounds(spark, monkeypatch):
    """Copies of one text with more and more edits, in buckets far above the sample."""
    monkeypatch.setattr(minhash, "SAMPLE", 4)
    monkeypatch.setattr(minhash, "HUBS", 2)
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "CHUNK", 32)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 22)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows]), 2, 80).collect()}
    assert got == brute(rows, 2, 80)


def test_odd_rows(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, "Word", "b"), (4, "word", "b"), (5, "w " * 300_000, "b"), (6, "W " * 200_000 + "w", "b"), (None, "word", "b"), (3, "Word", "b")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, node=x) for i, t, x in rows], "doc_id long, text string, node string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2, 80).collect())
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 5, False), (0, 1, 3, False)])
    kept = minhash.keep_one_of_each(docs, 2, 80)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5] and kept.columns == docs.columns
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k != 2000 and (k in got)} and set(label) - set(got) <= {a for a, b in edges if a == b}


def test_small_sets_at_the_threshold_are_not_estimated_away():
    rng, n = np.random.default_rng(11), 3000
    values = rng.integers(0, 1 << 54, (n, 5), np.uint64)
    starts = np.arange(n) * 9
    both = np.concatenate([values[:, :4], values], 1).ravel()  # sets of 4 and of 5: 0.80
    least = minhash.minima(both, np.sort(np.concatenate([starts, starts + 4])), minhash.FINE)
    a, b = (minhash.packed(least[:, k::2]).view(np.uint64) for k in (0, 1))
    assert (minhash.similarity(a, b, minhash.FINE) >= minhash.floor_estimate(0.8, minhash.FINE)).all()


def test_incidence_counts_common_shingles(monkeypatch):
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(300), rng.randint(1, 80))), np.uint64) for _ in range(40)]
    whole = [x.tobytes() if i % 7 else None for i, x in enumerate(sets)]
    sizes = np.array([len(x) for x in sets])
    for columns in (7, 8192):
        monkeypatch.setattr(minhash, "COLUMNS", columns)
        rows, cols = np.arange(3, 30), np.arange(40)
        small = minhash.Incidence(whole, sizes)
        got = small.common(rows, cols)
        part = np.ones(got.shape)
        small.rule_out(part, rows, cols, 0.2)
        for i, r in enumerate(rows):
            for j, c in enumerate(cols):
                if r != c and whole[r] and whole[c]:
                    both = len(set(sets[r].tolist()) & set(sets[c].tolist()))
                    assert got[i, j] == both and (part[i, j] == 1) == (5 * both >= sizes[r] + sizes[c] - both)
                elif r != c:
                    assert part[i, j] == 1
