"""A delivery that breaks anywhere and is replayed delivers and marks the same, once."""

import os

import pytest
from pyspark.sql import functions as F

from newsloom.operators import sketches
from newsloom.streaming.delivery import Delivery, mark_sent


class Killed(Exception):
    pass


class Files:
    """A receiver that keeps a file of each key, and how often it was asked."""

    def __init__(self, folder, refuses):
        self.folder, self.refuses = str(folder), refuses

    def __call__(self, key, text):
        if text in self.refuses:
            return False
        name = os.path.join(self.folder, key.replace(":", "-"))
        try:
            with open(name, "x") as f:
                f.write(text)
        except FileExistsError:
            assert open(name).read() == text  # the same key is the same message
        return True


def messages(spark, salt=""):
    rows = [(d, s, f"m{d}.{s}{salt}", [100 * d + s, 100 * d + 50 + s]) for d in range(6) for s in range(4)]
    return spark.createDataFrame(rows, "digest long, seq long, text string, item_ids array<long>")


@pytest.mark.parametrize("step", [None, "prepared", "sent", "committed"])
def test_replays_deliver_once(spark, tmp_path, step):
    (tmp_path / "received").mkdir()
    refuses = {"m1.0", "m2.2", "m3.3", "m5.1"}
    d = Delivery(spark, f"file://{tmp_path}/store", Files(tmp_path / "received", refuses))
    expect = {(g, s) for g, most in ((0, 4), (1, 0), (2, 2), (3, 3), (4, 4), (5, 1)) for s in range(most)}

    def kill(name):
        if name == step:
            raise Killed

    if step:
        with pytest.raises(Killed):
            d.deliver(messages(spark), 7, kill)
        assert {(r.digest, r.seq) for r in d.delivered().collect()} == (expect if step == "committed" else set())
    d.deliver(messages(spark, "" if step is None else " made anew"), 7)  # what went into the outbox first is what goes out
    assert {(r.digest, r.seq) for r in d.delivered().collect()} == expect
    assert sorted(os.listdir(tmp_path / "received")) == sorted(f"7-{g}-{s}" for g, s in expect)
    items = spark.range(0, 600).withColumn("sent", F.col("id") == 599)
    sent = {r.id for r in mark_sent(items, d.delivered()).filter("sent").collect()}
    assert sent == {599} | {i for g, s in expect for i in (100 * g + s, 100 * g + 50 + s)}
    d.deliver(messages(spark).filter("digest = 0"), 8)
    assert d.delivered().filter("batch = 8").count() == 4


def test_sketches_tell_quantiles_within_their_error(spark, tmp_path):
    import datetime as dt

    rows = spark.range(0, 60_000).select((F.col("id") % 3).alias("source_id"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("views"), F.lit(True).alias("sent"), F.lit(None).cast("long").alias("duplicate_of"), F.lit(None).cast("string").alias("blocked_reason"), F.timestamp_seconds(1_704_067_200 + F.col("id") % 9 * 86_400).alias("published_at"))
    path = f"file://{tmp_path}/sketches"
    for k in range(3):  # days arrive in any order, one of them twice
        sketches.add_days(rows.filter(F.dayofmonth("published_at") % 3 == k), path)
    sketches.add_days(rows.filter(F.dayofmonth("published_at") == 4), path)
    last = dt.date(2024, 1, 8)
    got = {r.source_id: r for r in sketches.baseline(spark, path, last, 7).collect()}
    for s in range(3):
        values = sorted(r.views for r in rows.filter((F.col("source_id") == s) & F.dayofmonth("published_at").between(2, 8)).collect())
        assert got[s].posts == len(values)
        rank = sum(v <= got[s].usual for v in values) / len(values)
        assert abs(rank - 0.5) <= sketches.RANK_ERROR
    plan = sketches.baseline(spark, path, last, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_day_of_sketches_is_one_file(spark, tmp_path):
    import glob

    rows = spark.range(0, 9_000, 1, 6).select((F.col("id") % 30).alias("source_id"), F.col("id").alias("views"), F.lit(True).alias("sent"), F.lit(None).cast("long").alias("duplicate_of"), F.lit(None).cast("string").alias("blocked_reason"), F.timestamp_seconds(1_704_067_200 + F.col("id") % 9 * 86_400).alias("published_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sketches.add_days(rows, f"file://{tmp_path}/sketches")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{tmp_path}/sketches/day=*/*.parquet")) == 9
