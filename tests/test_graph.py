"""Components in increments, and threads as ranked lists."""

import math
import random

import pytest

from newsloom.operators import digest, graph


def least(edges):
    """id: least id reachable."""
    up = {}
    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


@pytest.mark.parametrize("seed", [1, 2])
def test_ten_increments_give_the_labels_of_one_run(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 150), draw.randint(0, 150)) for _ in range(110)]
    parts = [edges[k::10] for k in range(10)]
    parts[3] = []  # nothing new
    parts[4] += parts[2]  # told again
    grown = graph.GrowingComponents(spark)
    for k, part in enumerate(parts):
        grown.add(spark.createDataFrame(part, "a long, b long"))
        if k in (2, 9):
            got = [(r.id, r.component) for r in grown.labels().collect()]
            assert len(got) == len({i for i, _ in got}) and dict(got) == least([e for p in parts[: k + 1] for e in p])


def walked(lines):
    """Depth first by position; loops, and what answers them, at the end. lines: id, position, parent."""
    known = {i for i, _, _ in lines}
    below, out = {}, []
    for i, p, up in sorted(lines, key=lambda x: (x[1], x[0])):
        below.setdefault(up if up in known else None, []).append(i)
    stack = list(reversed(below.get(None, [])))
    while stack:
        i = stack.pop()
        out.append(i)
        stack += reversed(below.get(i, []))
    nested = {i for i, _, up in lines if up in known and i in set(out)}
    return out + [i for i, p, _ in sorted(lines, key=lambda x: (x[1], x[0])) if i not in set(out)], nested


def test_threads_are_walked_depth_first(spark):
    draw = random.Random(7)
    table, expect = [], {}
    for d in range(40):
        n = draw.randint(1, 25)
        lines = [(i, draw.randint(0, 9), draw.choice([None, 999, *range(n)])) for i in range(n)]
        table += [(d, *x) for x in lines]
        expect[d] = walked(lines)
    got = digest.threads(spark.createDataFrame(table, "digest long, id long, position long, parent long")).collect()
    for d, (order, nested) in expect.items():
        mine = sorted((r.place, r.id, r.nested) for r in got if r.digest == d)
        assert [i for _, i, _ in mine] == order and [p for p, _, _ in mine] == list(range(1, len(order) + 1))
        assert {i for _, i, deep in mine if deep} == nested


def test_a_long_chain_takes_logarithmic_rounds_and_two_rows_a_line(spark, monkeypatch):
    n, rounds = 20_000, []
    plain = digest.counted_cut

    def noted(frame, what):
        rounds.append(frame.columns)
        return plain(frame, what)

    monkeypatch.setattr(digest, "counted_cut", noted)
    chain = spark.range(n).selectExpr("1L AS digest", "id", f"{n} - id AS position", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    got = digest.threads(chain)
    assert got.filter("place = id + 1 AND nested = (id > 0)").count() == n
    assert len(rounds) <= math.log2(2 * n) + 2 and all(c == ["digest", "step", "next", "entered", "top"] for c in rounds)
