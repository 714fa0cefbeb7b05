import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from newsloom.llm import periodic_runs as P

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=12):
    """By definition: maximal stretches of every period, but those with a smaller one."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            size = e - i + q
            if size >= max(least, 2 * q) and not any(w[i : i + size - r] == w[i + r : i + size] for r in range(1, q)):
                out.append((i, size, q))
            i = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = SPACE.findall(text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def described(rows):
    return P._described([i for i, _ in rows], pa.array([(t or "").encode() for _, t in rows], pa.binary()))


WORDS = st.lists(st.sampled_from("a b c".split()), max_size=60)
REPEATED = st.tuples(WORDS, st.lists(st.sampled_from("a b c d".split()), min_size=1, max_size=9), st.integers(1, 12), WORDS).map(lambda x: x[0] + x[1] * x[2] + x[3])


@pytest.mark.parametrize("few", [0, P.FEW, 10**9])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(WORDS, REPEATED), min_size=1, max_size=5), st.integers(0, 50))
def test_equals_brute_force(few, texts, seed):
    before, P.FEW = P.FEW, few
    try:
        rows = [(seed + k, " ".join(t)) for k, t in enumerate(texts)]
        assert described(rows) == [brute(*r) for r in rows]
    finally:
        P.FEW = before


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_words_full_of_runs():
    thue = [str(bin(k).count("1") % 2) for k in range(600)]
    rng = np.random.default_rng(1)
    blocks = [x for k in range(40) for x in ["p", "q", "r"][: 1 + k % 3] * (1 + k % 5)]
    for w in (fibonacci(800), thue, blocks, ["a"] * 700, list("ab" * 300 + "a"), [str(x) for x in rng.integers(0, 2, 900)], list(("abcabd" * 7 + "x") * 9)):
        rows = [(None, " ".join(w)), (1, " ".join(w[::-1]))]
        assert described(rows) == [brute(*r) for r in rows]


def test_texts_that_are_through_before_others():
    """A text that lacks the last word of a square, refined beside longer ones."""
    draw = np.random.default_rng(4)
    long = [str(x) for x in draw.integers(0, 3, 300)]
    for q in range(4, 24):
        block = [f"w{k}" for k in range(q)]
        rows = [(None, " ".join(w)) for w in (block * 2, (block * 2)[:-1], ["x", *block, *block[:-1]], [*(block * 2)[1:], "y"], block + block[:-2], long + block * 3, block * 40 + block[:-1])]
        assert described(rows) == [brute(*r) for r in rows]


def test_words_are_bytes_and_spaces_are_ascii():
    nbsp = " "
    rows = [(None, "é  " * 12), (None, "A a " * 6), (None, "x\tx\nx\x0bx\x0cx\rx " * 2), (None, f"a{nbsp}b " * 11), (None, "0\x00 " * 30)]
    assert described(rows) == [brute(*r) for r in rows]


def test_colliding_hashes(monkeypatch):
    rows = [(None, "a b " * 8 + "c a b c " * 5), (1, "x y z " * 9), (2, "a " * 12)]
    expect = [brute(*r) for r in rows]

    class Weak(P.Words):
        def __init__(self, raw, at):
            super().__init__(raw, at)
            self.hash = self.hash % np.uint64(2)

    monkeypatch.setattr(P, "Words", Weak)
    assert described(rows) == expect
    long = "w" * (2 << 19)
    assert described([(None, f"{long}a {long}b " * 7)]) == [brute(None, f"{long}a {long}b " * 7)]


def test_long_texts_are_not_quadratic():
    begin = time.time()
    assert described([(None, "a " * 300_000)])[0][1:6] == (1, 0, 300_000, 1, 300_000_000)
    assert described([(None, ("b " * 99 + "c ") * 2_000)])[0][1] == 2_001
    assert described([(None, " ".join(fibonacci(100_000)))])[0][1] > 20_000
    assert time.time() - begin < 60


def test_rows(spark):
    text = "one two three " * 9
    rows = [Row(doc_id=1, text=text, period=5, start="x"), Row(doc_id=1, text=text, period=6, start="y"), Row(doc_id=2, text=None, period=0, start=None), Row(doc_id=None, text="", period=0, start=None), Row(doc_id=None, text=" \t\n", period=0, start=None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period int, start string")
    got = sorted((tuple(r) for r in P.periodic_runs(docs).collect()), key=str)
    assert got == sorted((brute(r.doc_id, r.text) for r in rows), key=str)
    assert got[-1][1:6] == (0, None, None, None, None) or got[0][1:6] == (0, None, None, None, None)
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in docs if len(d.text.split()) < 1500]
    got = {r.doc_id: tuple(r) for r in P.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    for d in short:
        assert got[d.doc_id] == brute(d.doc_id, d.text)
