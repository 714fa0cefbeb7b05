"""The automaton of literal rules finds what the chain of tests finds."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import phrases, rules

PIECES = ["a", "b", "ab", "aba", "ß", "ss", "é", " ", "  ", "\t", "-", "–", "--", " - ", "'", "’", "`", ".", "*", "​", "Ab", "\n", "[x]", "$"]
SCHEMA = "id long, raw_text string, category string, source_id long"


def drawn(seed, n, most):
    draw = random.Random(seed)
    return ["".join(draw.choices(PIECES, k=draw.randint(0, most))) for _ in range(n)]


def tables(spark, seed=3):
    draw = random.Random(seed)
    items = [(k, t, draw.choice(["feed", "tech", None]), draw.choice([1, 2, None])) for k, t in enumerate(drawn(seed, 400, 30))] + [(1000, None, "feed", 1), (1001, "", None, None)]
    texts = drawn(seed + 1, 120, 4) + ["-", "--", "– -", "'", "", "  ", "a-b", "a – b", "ß", "’a"]
    ruled = [(k, f" = {t}" if k % 2 else f"={t}", None) for k, t in enumerate(texts)] + [(900, "a judged rule", None)]
    links = ([(k, c) for k in range(0, len(texts), 3) for c in ("feed", "other")[: 1 + k % 2]], [(k, s) for k in range(0, len(texts), 4) for s in (1, 3)])
    made = rules.scoped(spark.createDataFrame(ruled, "word_id long, rule string, label string"), spark.createDataFrame(links[0], "word_id long, category string"), spark.createDataFrame(links[1], "word_id long, source_id long"))
    return spark.createDataFrame(items, SCHEMA), made


def hits(frame):
    return {r.id: r.hit for r in frame.select("id", "hit").collect()}


def test_automaton_equals_the_chain_of_tests(spark):
    items, made = tables(spark)
    expect = hits(rules.literal_hits(items, made, nested=1000))
    assert 30 < len([h for h in expect.values() if h]) and len(set(expect.values())) > 15
    assert hits(rules.literal_hits(items, made, nested=0)) == expect


@pytest.mark.parametrize("most", [12, 40])
def test_groups_keep_the_order_of_rules(spark, most):
    items, made = tables(spark, 11)
    made = made.filter("word_id < 20 OR word_id >= 120")
    assert hits(phrases.first_hits(items, made, "=", most)) == hits(rules.literal_hits(items, made, nested=1000))


def test_no_rules_and_no_items(spark):
    items, made = tables(spark)
    assert set(hits(phrases.first_hits(items, made.filter("word_id = 900"), "=")).values()) == {None}
    assert hits(rules.literal_hits(items.limit(0), made)) == {}
    out = rules.literal_hits(items, made)
    assert out.columns == [*items.columns, "hit"]


def test_groups_are_bounded():
    class R:
        def __init__(self, k):
            self.plain = self.key = "x" * (1 + k % 7)
            self.rule, self.categories, self.source_ids = str(k), [], []

    groups = list(phrases.grouped((R(k) for k in range(100)), 20))
    assert [g[2] for group in groups for g in group] == [str(k) for k in range(100)]
    assert max(sum(len(g[0]) for g in group) for group in groups) <= 20


def test_rules_beyond_an_automaton_are_joined(spark):
    items, made = tables(spark, 5)
    expect = hits(rules.literal_hits(items, made, nested=1000))
    assert hits(phrases.first_hits(items, made, "=", 1)) == expect and len(set(expect.values())) > 15


def test_no_worker_holds_the_rules(spark, monkeypatch):
    """Of more rules than an automaton has, nothing but a bitmap is broadcast."""
    monkeypatch.setattr(phrases, "_search", None)
    draw = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    lines = [" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(300)]
    phrased = [" ".join(draw.choices(words, k=draw.choice([1, 2, 2, 3, 9]))) for _ in range(400)] + [lines[7][:90], lines[8][3:75], lines[9]]
    items = spark.createDataFrame([(k, t, None, k % 3 or None) for k, t in enumerate([*lines, lines[7], lines[9] + lines[8]])], SCHEMA)
    ruled = spark.createDataFrame([(k, f"={p}", None) for k, p in enumerate(phrased[::-1] + phrased)], "word_id long, rule string, label string")
    made = rules.scoped(ruled, spark.createDataFrame([], "word_id long, category string"), ruled.filter("word_id % 2 = 0").selectExpr("word_id", "word_id % 3 AS source_id"))
    scopes = {r.word_id: (r.rule[1:].strip(), r.source_ids) for r in made.collect()}
    expect = {}
    for r in items.collect():
        mine = [k for k, (p, s) in scopes.items() if p and p in r.raw_text.strip() and (not s or r.source_id in s)]
        expect[r.id] = "=" + scopes[min(mine)][0] if mine else None
    got = {k: h and "=" + h[1:].strip() for k, h in hits(phrases.first_hits(items, made, "=", 100)).items()}
    assert got == expect and len(set(expect.values())) > 25


@pytest.mark.parametrize("piece", [1, 16, 100])
def test_texts_are_looked_at_piece_by_piece(spark, monkeypatch, piece):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(phrases, "PIECE", piece)
    draw = random.Random(piece)
    texts = ["".join(draw.choices("abé ", k=draw.randint(0, 90))) for _ in range(40)] + [None, ""]
    some = sorted({t[k : k + n].encode() for t in texts if t for k, n in [(draw.randint(0, 40), draw.choice([1, 2, 7, 8, 9, 16, 33]))]} - {b""})
    bits = 1 << 15
    bitmap = np.zeros(bits // 8, np.uint8)
    for batch in phrases._bits_of(bits)(iter([pa.RecordBatch.from_arrays([pa.array(some)], ["pattern"])])):
        for b in batch.column(0).to_pylist():
            bitmap[b // 8] |= 1 << b % 8

    class Shared:
        value = bitmap.tobytes()

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["owner", "text"]).slice(3)
    got = {(o, p) for b in phrases._found(Shared, sorted({len(p) for p in some}), bits)(iter([batch])) for o, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    expect = {(k, p) for k, t in enumerate(texts) if t and k >= 3 for p in some if p in t.encode()}
    assert {x for x in got if x[1] in some} == expect and len(got) < 3 * len(expect)


@pytest.mark.parametrize("bounds", [2, 8])
def test_few_of_what_a_text_holds_are_looked_up(spark, monkeypatch, bounds):
    """However few are looked up at first, the first rule in its scope is found, be its bound shared or the first ones out of scope."""
    monkeypatch.setattr(phrases, "BOUNDS", bounds)
    monkeypatch.setattr(phrases, "PIECE", 200)
    items, made = tables(spark, 21)
    far = (F.col("word_id") - 60) * (1 << 53)  # further apart than bounds can tell
    made = made.withColumn("source_ids", F.when(F.col("word_id") < 60, F.array(F.lit(77).cast("bigint"))).otherwise(F.col("source_ids"))).withColumn("word_id", far)
    expect = hits(rules.literal_hits(items, made, nested=0))
    assert hits(phrases.first_hits(items, made, "=", 1)) == expect and len(set(expect.values())) > 10


def test_the_join_gets_few_of_what_a_text_holds():
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"w{k}" for k in range(500))
    some = [f"w{k} w{k + 1}".encode() for k in range(499)]
    bits = 1 << 15
    bitmap = np.zeros(bits // 8, np.uint8)
    for batch in phrases._bits_of(bits)(iter([pa.RecordBatch.from_arrays([pa.array(some)], ["pattern"])])):
        for b in batch.column(0).to_pylist():
            bitmap[b // 8] |= 1 << b % 8
    table = np.full(1 << 16, phrases._NONE, np.uint32)
    (made,) = phrases._slots_of(1 << 16)(iter([pa.RecordBatch.from_arrays([pa.array(some), pa.array(range(1000, 1499))], ["pattern", "bound"])]))
    np.minimum.at(table, made.column(0).to_numpy() * phrases.BLOCK + made.column(1).to_numpy(), made.column(2).to_numpy().astype(np.uint32))

    def shared(x):
        return type("Shared", (), {"value": x.tobytes()})

    def found(least, last):
        batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text]), pa.array([least]), pa.array([last])], ["owner", "text", "least", "last"])
        out = [b.to_pylist() for b in phrases._found(shared(bitmap), sorted({len(p) for p in some}), bits, shared(table), 8)(iter([batch]))]
        return [r for b in out for r in b if r["pattern"] in some]

    begin = found(0, phrases._NONE - 1)
    assert set(some[:7]) <= {r["pattern"] for r in begin} and 8 <= len(begin) < 20 and {r["next"] for r in begin} - {None}
    assert [r["pattern"] for r in found(1100, 1101) if r["pattern"] in some[100:102]] and not {r["next"] for r in found(1100, 1101)} - {None}
