import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row

from newsloom.llm.common import documents
from newsloom.llm.substring_dedup import SubstringDedup, query


def brute(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randint(5, 120))] for _ in range(8)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 50))]
            part = rng.choice(shared)
            a = rng.randint(0, len(part) // 2)
            words += part[a : a + rng.randint(1, 120)]
            if rng.random() < 0.2:
                words += ["la"] * rng.randint(1, 50)
            if words and rng.random() < 0.3:
                words[rng.randrange(len(words))] = "É"
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize(("window", "vocabulary"), [(35, 5000), (35, 3), (10, 3), (5, 2), (3, 50)])
def test_windows_match_brute_force(spark, window, vocabulary):
    rows = passages(window + vocabulary, vocabulary)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, kept="k", v=1) for i, t in rows])
    got = sorted((tuple(r) for r in SubstringDedup(docs, window).members.collect()), key=str)
    assert got == brute(rows, window)


def test_documents_match_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = sorted((tuple(r) for r in query(spark, "/root/testdata/sf0.01").collect()), key=str)
    expect = brute([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert sum(x[2] for x in expect) > 0
    assert got == expect


def test_odd_rows(spark):
    long = " ".join(f"a{i % 977}b{i // 977}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, "one two"), (4, long), (4, long), (None, "x " * 35), (5, "x " * 34), (6, "y " * 36)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in rows], "doc_id long, text string")
    got = sorted((tuple(r) for r in SubstringDedup(docs).members.collect()), key=str)
    assert got == brute(rows, 35)
    texts = {r.doc_id: r.kept for r in SubstringDedup(docs).texts.collect()}
    assert texts[3] == "one two" and texts[4] == "" and texts[6] == ""
    assert SubstringDedup(docs.limit(0)).members.count() == 0
