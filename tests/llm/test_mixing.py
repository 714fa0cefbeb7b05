import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from newsloom.llm import mixing


def brute_period(quota, period):
    done, out = [0] * len(quota), []
    for t in range(period):
        ready = [(-(-(done[i] + 1) * period // q), i) for i, q in enumerate(quota) if done[i] * period // q <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("quota", [[1, 1, 62], [32, 16, 8, 8], [64], [13, 17, 19, 5, 10], [21, 21, 22]])
def test_period_is_earliest_deadline_first(spark, quota):
    df = spark.createDataFrame([Row(i=i, q=q) for i, q in enumerate(quota)], "i int, q long")
    got = [r.i for r in mixing.period_slots(df, 64).orderBy("slot").collect()]
    assert got == brute_period(quota, 64)
    seen = Counter()
    for t, i in enumerate(got, 1):
        seen[i] += 1
        assert all(abs(seen[k] - t * q / 64) < 1 for k, q in enumerate(quota))


def corpus(spark):
    rows = [Row(doc_id=i, text=f"t{i}", source=s, slot=i, key="k") for s, n in (("a", 300), ("b", 40), ("c", 7)) for i in range(n)]
    rows += [Row(doc_id=None, text=None, source=None, slot=None, key=None)] * 3 + [Row(doc_id=1, text="t1", source="a", slot=1, key="k")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot long, key string")


def test_mixture_holds_its_weights_and_loses_nothing(spark):
    docs = corpus(spark)
    rows = mixing.mix(docs, [F.col("doc_id"), F.col("source")], block_rows=4, period=64).collect()
    assert all(r.release <= r.slot < r.deadline for r in rows)
    first = Counter((r.source, r.doc_id) for r in rows if r.epoch == 0)
    assert first == Counter((r.source, r.doc_id) for r in docs.collect())
    by_slot = defaultdict(set)
    for r in rows:
        by_slot[r.slot].add((r.source, r.block))
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(x) == 1 for x in by_slot.values())
    places = Counter((r.slot, r.place) for r in rows)
    assert max(places.values()) == 1
    q = {r.key: r.q for r in mixing.shares(mixing._ranked(docs, [F.col("doc_id")])[1], None, mixing.ALPHA, 64).collect()}
    assert sum(q.values()) == 64
    seen = Counter()
    for t in range(len(by_slot)):
        source = next(iter(by_slot[t]))[0]
        seen["" if source is None else "s" + source] += 1
        assert all(abs(seen[k] - (t + 1) * x / 64) < 1 for k, x in q.items())


def test_given_weights_and_order(spark):
    docs = corpus(spark)
    out = mixing.mixed_documents(docs, weights={"a": 1.0, "b": 1.0, "zz": 5.0}, block_rows=1, period=64)
    assert out.columns == docs.columns
    shares = Counter(r.source for r in out.collect())
    assert abs(shares["a"] - shares["b"]) <= 1 and shares["c"] >= 7
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs, weights={}, period=64).count() > 0


def test_no_python_on_the_executors(spark):
    plan = mixing.mix(corpus(spark), [F.col("doc_id")])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sources_of_one_quota_take_turns(spark):
    rng = random.Random(3)
    quota = [1 + rng.randrange(4) for _ in range(180)]
    period = 512
    quota[7] += period - sum(quota)
    df = spark.createDataFrame([Row(i=i, q=q) for i, q in enumerate(quota)], "i int, q long")
    assert [r.i for r in mixing.period_slots(df, period).orderBy("slot").collect()] == brute_period(quota, period)


def test_many_sources_get_a_longer_period(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text="t", source=f"s{i % 90}") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, [F.col("doc_id")], block_rows=2, period=64).collect()
    assert {r.doc_id for r in rows} == set(range(400)) and all(r.release <= r.slot < r.deadline for r in rows)
    assert sorted({r.slot for r in rows}) == list(range(len({r.slot for r in rows})))


def test_lopsided_weights_repeat_no_row_without_end(spark):
    docs = spark.createDataFrame([Row(doc_id=i, source="small" if i < 10 else "large") for i in range(4000)], "doc_id long, source string")
    for weights in ({"small": 1.0}, {"small": 1.0, "large": 1e-9}):
        rows = mixing.mix(docs, [F.col("doc_id")], weights=weights, block_rows=4, period=64, epochs=5).collect()
        seen = Counter(r.doc_id for r in rows)
        assert set(seen) == set(range(4000)) and max(seen.values()) <= 5
        assert all(r.release <= r.slot < r.deadline for r in rows)


def test_oracle_agrees(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    expect = con.sql(mixing.ORACLE).fetchall()
    names = [d[0] for d in con.sql(mixing.ORACLE).description]
    got = mixing.query(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(expect)


def test_given_weights_are_kept_however_small_the_source(spark):
    docs = spark.createDataFrame([Row(doc_id=i, source="small" if i < 10 else "large") for i in range(2000)], "doc_id long, source string")
    rows = mixing.mix(docs, [F.col("doc_id"), F.col("source")], weights={"small": 1.0, "large": 1.0}, block_rows=4, period=64).collect()
    slots = {r.slot: r.source for r in rows}
    assert sorted(slots) == list(range(len(slots))) and {r.doc_id for r in rows} == set(range(2000))
    for n in range(1, len(slots) + 1, 37):
        assert abs(sum(slots[k] == "small" for k in range(n)) - n / 2) < 1
    assert max(r.epoch for r in rows) > 100
