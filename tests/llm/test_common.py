import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import common


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("text"), F.lit(1).alias("_metadata"), F.lit(2).alias("_row"))
    rows.repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


@pytest.mark.parametrize("blocks", [1, 3, 16_384])
def test_places_tell_rows_apart(spark, table, monkeypatch, blocks):
    """With few blocks a group there are many groups, and files in several pieces; the rows are the same."""
    monkeypatch.setattr(common, "BLOCK_BITS", 6)
    monkeypatch.setattr(common, "GROUP_BLOCKS", blocks)
    wanted = table.withColumn("w", F.col("id") % 5 == 0).select("w", *common.row_key(table)).filter("w")
    places = common.Places(table, wanted)
    assert (len(places.groups) > 1) == (blocks < 100)
    inside = [r.id for part in places.rows([F.col("id")]) for r in part.collect()]
    assert sorted(inside) == list(range(0, 500, 5))
    outside = [r.id for part in places.others([F.col("id")]) for r in part.collect()]
    assert sorted(outside) == [i for i in range(500) if i % 5]
    got = common.without(table, wanted)
    assert got.columns == table.columns and sorted(r.id for r in got.select("id").collect()) == sorted(outside)
    found = places.gather([F.col("id")], lambda rows: rows.select(F.col("id") + 1), "test")
    assert sorted(r[0] for r in found.collect()) == [i + 1 for i in sorted(inside)]
    nothing = common.Places(table, wanted.limit(0))
    assert nothing.gather([F.col("text")], lambda rows: rows, "none").count() == 0
    assert common.without(table, wanted.limit(0)).count() == 500


def test_rows_do_not_move(spark, table):
    wanted = table.filter("id < 50").select(*common.row_key(table))
    plan = next(iter(common.Places(table, wanted).rows([F.col("text")])))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    plan = common.without(table, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_scratch_tables_go(spark, tmp_path):
    df = spark.range(5)
    with common.Scratch(spark) as outer:
        a = common.materialise(df, "a")
        with common.Scratch(spark) as inner:
            common.materialise(df, "b")
            b = inner.keep(df, "c")
        c = outer.keep(df, "d")
        paths = [t.rsplit("-", 1)[0].rsplit("-", 1)[1] for t in common._tables]
        assert "b" not in paths[-4:] and b.count() == 5
        assert a.count() == 5
    assert c.count() == 5
    with pytest.raises(Exception, match="(?i)file"):
        a.collect()


@pytest.mark.parametrize("segment", [1, 2, 7, 64, 1 << 19])
def test_words_of_any_segments_are_the_same(monkeypatch, segment):
    rng = random.Random(1)
    texts = ["", " ", "one", " two  words ", "x" * 50, "Ünï cödé\x0b\ttabs", "", "glued", "more" * 9 + " end"] + ["".join(rng.choices("ab \n", k=rng.randint(0, 40))) for _ in range(60)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    monkeypatch.setattr(common, "SEGMENT", segment)
    got = common.Words(raw, at)
    expect = [w for t in texts for w in t.encode().split()]
    assert [bytes(raw[s:e]) for s, e in zip(got.start, got.end, strict=True)] == expect
    assert np.diff(got.first).tolist() == [len(t.encode().split()) for t in texts]
    hashes = dict(zip(expect, got.hash.tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes) and [hashes[w] for w in expect] == got.hash.tolist()
    monkeypatch.undo()
    assert (common.Words(raw, at).hash == got.hash).all()
    lowered = common.Words(np.frombuffer("A b a B".encode(), np.uint8), np.array([0, 7]), lower=True)
    assert lowered.hash[0] == lowered.hash[2] and lowered.hash[1] == lowered.hash[3]
