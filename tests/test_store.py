"""The store by day: pruned reads, replayed batches, killed compactions, retention."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.streaming.store import ALL, Store

DAY = dt.date(2024, 1, 5)


def posts(spark, *ids, at="2024-01-05 10:00:00"):
    rows = spark.createDataFrame([(f"m{i}", i % 3) for i in ids], "message_id string, source_id long")
    return rows.select("message_id", "source_id", F.lit(at).cast("timestamp").alias("published_at"), F.lit(False).alias("late"), F.lit(at).cast("timestamp").alias("stored_at"))


def ids(frame):
    return sorted(int(r.message_id[1:]) for r in frame.collect())


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/store")
    for k in range(4):
        out.write(posts(spark, 10 * k, 10 * k + 1), f"s-{k}", DAY + dt.timedelta(days=k // 2))
    return out


def test_reads_prune_days(spark, store):
    assert ids(store.read()) == [0, 1, 10, 11, 20, 21, 30, 31]
    late = store.read(since=DAY + dt.timedelta(days=1))
    assert ids(late) == [20, 21, 30, 31]
    plan = late.select("message_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-06" in plan and "ReadSchema: struct<message_id:string>" in plan
    assert all("day=2024-01-06" in f for f in late.inputFiles())
    assert ids(Store(spark, store.path + "-none").read()) == []


def test_a_batch_that_is_written_again_replaces_itself(spark, store):
    store.write(posts(spark, 7), "s-1", DAY + dt.timedelta(days=1))  # on the next day: its day stays
    assert ids(store.read()) == [0, 1, 7, 20, 21, 30, 31]
    assert store.parts()["2024-01-05"] == ["s-0", "s-1"]


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", [None, "written", "committed"])
def test_a_killed_compaction_changes_nothing(spark, store, step):
    def kill(name):
        if name == step:
            raise Killed

    if step:
        with pytest.raises(Killed):
            store.compact(kill)
        assert ids(store.read()) == [0, 1, 10, 11, 20, 21, 30, 31]
        store.write(posts(spark, 40), "s-4", DAY)  # a batch between
        assert ids(store.read()) == [0, 1, 10, 11, 20, 21, 30, 31, 40]
    store.compact()
    assert ids(store.read()) == [0, 1, 10, 11, 20, 21, 30, 31] + [40] * bool(step)
    parts = store.parts()
    assert set(parts) == {"2024-01-05", "2024-01-06"} and all(len(p) == 1 and p[0].startswith(ALL) for p in parts.values())
    folders = store._names("day=*", "part=*")
    assert len(folders) == 2 and len(store._names("_commits", "*")) == 2  # nothing is left over
    assert store.compact() == []


def test_whole_days_expire(spark, store):
    store.compact()
    assert store.expire(DAY + dt.timedelta(days=1)) == ["2024-01-05"]
    assert ids(store.read()) == [20, 21, 30, 31] and store._names("day=*") == ["day=2024-01-06"]
    assert len(store._names("_commits", "*")) == 1 and store.expire(DAY) == []
