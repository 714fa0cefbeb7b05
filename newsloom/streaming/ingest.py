"""Polls as micro-batches: exactly-once ingest by message identity, and the life of a source."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.fold import folded
from newsloom.operators.graph import shared_folder
from newsloom.operators.state import unseen
from newsloom.streaming.store import Store


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/newsloom-{name}-{uuid.uuid4().hex}"


def posts_stream(spark: SparkSession, folder: str, files: str, at_once: int = 50) -> DataFrame:
    """Parquet files of events that arrive in a folder, as a stream of posts; `at_once` of them are a batch."""
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", at_once).parquet(folder)
    key = F.get_json_object("props", "$.k")
    return events.select(
        F.concat_ws("_", F.lit("tg"), F.col("user_id").cast("string"), key).alias("message_id"),
        F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("published_at"), (F.col("event_type") == "error").alias("failed"), (key.cast("int") < 50).alias("client"), F.col("event_id").alias("seq"),
    )


LATE = "48 hours"
RETENTION_DAYS = 30


def ingest(posts: DataFrame, store: str, checkpoint: str, as_of: Column | None = None, late: str = LATE, retention: int = RETENTION_DAYS) -> None:
    """ST02/ST03/ST07: each message is stored once, however often it is polled or a batch is retried, and however late.

    No watermark drops anything: a post older than `late` at as_of (default: the time of the batch) is
    stored with the flag `late`, one without a time as it is, young. Of several with one message_id in
    a batch the earliest stays (one without a time last); what the store has falls to an anti-join in
    the batch, so a restart with a lost checkpoint doesn't store twice either. It looks back over the
    days of the retention and reads no others. A batch is a part of its own (store.Store): writing it
    again replaces it, and no other stream writes there.
    """
    spark = posts.sparkSession
    files = Store(spark, store)

    def save(batch: DataFrame, number: int) -> None:
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.md5(checkpoint.encode()).hexdigest()
        part = f"{stream}-{number}"
        now = F.current_timestamp() if as_of is None else as_of
        today = spark.range(1).select(now.cast("date").alias("day")).first().day
        first = F.min_by(F.struct("source_id", "published_at"), F.struct(F.col("published_at").isNull().alias("none"), "published_at", "seq")).alias("first")
        rows = batch.groupBy("message_id").agg(first).select("message_id", "first.*")
        rows = rows.withColumn("late", F.coalesce(F.col("published_at") < now - F.expr(f"INTERVAL {late}"), F.lit(False))).withColumn("stored_at", now)
        have = files.read(since=today - dt.timedelta(days=retention))
        files.write(unseen(rows, have.filter(F.col("part") != part)), part, today)

    posts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored_once(spark: SparkSession, events: DataFrame, as_of: Column, polls: int) -> DataFrame:
    """Polls of a source's events, each a file that arrives later than the one before. events: poll, and the columns of posts_stream.

    The stream is stopped after each poll; before the last it has lost its checkpoint, and finds all files again.
    """
    arrived, store, place = (shared_path(spark, n) for n in ("arrived", "store", "stream"))
    for k in range(polls):
        events.filter(F.col("poll") == k).drop("poll").coalesce(1).write.mode("append").parquet(arrived)
        ingest(posts_stream(spark, arrived, "*.parquet"), store, place if k < polls - 1 else place + "-new", as_of)
    return Store(spark, store).read().select("message_id", "source_id", "late", "published_at")


ERROR_AFTER = 3
#: Failures in a row that the administrator hears of: of any kind, or of a kind that asking again won't heal.
ALERT_AT, CLIENT_ALERT_AT = 8, 2


def life(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """ST10: a source fails; so many failures in a row make it an error, one success revives it; long outages are told once."""
    fails, errors, alerts = state.get if state.exists else (0, 0, 0)
    polls = pd.concat(list(frames)).sort_values(["published_at", "seq"])
    for failed, client in zip(polls["failed"], polls["client"], strict=True):
        fails = fails + 1 if failed else 0
        errors += fails == ERROR_AFTER
        alerts += failed and (fails == ALERT_AT or (client and fails == CLIENT_ALERT_AT))
    state.update((int(fails), int(errors), int(alerts)))
    yield pd.DataFrame({"source_id": [key[0]], "fails": [fails], "errors": [errors], "alerts": [alerts], "status": ["error" if fails >= ERROR_AFTER else "active"]})


def lifecycle(polls: DataFrame) -> DataFrame:
    """A row of each source and micro-batch: failures in a row, times it became an error, alerts, status."""
    return polls.groupBy("source_id").applyInPandasWithState(life, "source_id long, fails long, errors long, alerts long, status string", "fails long, errors long, alerts long", "append", GroupStateTimeout.NoTimeout)


def source_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "lives")
    stream = lifecycle(posts_stream(spark, sf_dir, "events.parquet"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def throttled(alerts: DataFrame, seconds: int = 3600) -> DataFrame:
    """Alerts that go out: the first of a key, then none for that long. alerts: key, moment, seq.

    What counts is the last alert that went out, so a key's alerts are a fold in order of time.
    """

    def step(last: float | None, row: dict) -> tuple[float, dict | None]:
        if last is not None and row["at"] - last < seconds:
            return last, None
        return row["at"], {"key": row["key"], "seq": row["seq"]}

    rows = alerts.select("key", F.unix_micros("moment").alias("at_us"), "seq").withColumn("at", F.col("at_us") / 1e6).drop("at_us")
    return folded(rows, "key", ["at", "seq"], step, "key string, seq long")
