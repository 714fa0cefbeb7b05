"""Delivery of digests in two phases, so that what was delivered and what counts as sent can't part.

    <path>/outbox/batch=<n>    the messages of a batch, fixed before any goes out
    <path>/acks/batch=<n>      what the receiver took of each digest, up to its first failure
    <path>/manifest/<n>        there once the acks are whole: put into place by a rename

A batch that is replayed starts where it broke: an outbox that is there isn't made again, a manifest that
is there ends it. Between the two the messages go out again with the keys they had, which the receiver
takes once, so nothing is delivered twice; what counts as sent comes from batches with a manifest alone.
Messages of a digest go out in order, in one task; digests are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "digest bigint, seq bigint, text string, item_ids array<bigint>"
ACKS = "digest bigint, seq bigint, item_ids array<bigint>"
#: (key, text) -> whether the receiver has it; the same key again is the same message.
Receiver = Callable[[str, str], bool]


class Delivery:
    def __init__(self, spark: SparkSession, path: str, receiver: Receiver) -> None:
        self.spark, self.path, self.receiver = spark, path.rstrip("/"), receiver
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, *names: str) -> bool:
        return self._fs.exists(self._hadoop.Path("/".join([self.path, *names])))

    def deliver(self, messages: DataFrame, number: int, killed_at: Callable[[str], None] = lambda step: None) -> None:
        """Batch `number` of messages (MESSAGES), wherever an earlier attempt broke. killed_at: for tests, called after each step."""
        if self._there("manifest", str(number)):
            return
        outbox, acks = (f"{self.path}/{name}/batch={number}" for name in ("outbox", "acks"))
        if not self._there("outbox", f"batch={number}", "_SUCCESS"):
            messages.select("digest", "seq", "text", "item_ids").write.mode("overwrite").parquet(outbox)
        killed_at("prepared")
        receiver = self.receiver

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest, broken = None, False
            for b in batches:
                taken = []
                for k, (d, seq, text) in enumerate(zip(b.column("digest").to_pylist(), b.column("seq").to_pylist(), b.column("text").to_pylist(), strict=True)):
                    if d != digest:
                        digest, broken = d, False
                    broken = broken or not receiver(f"{number}:{d}:{seq}", text)
                    if not broken:
                        taken.append(k)
                yield b.take(pa.array(taken, pa.int64())).select(["digest", "seq", "item_ids"])

        rows = self.spark.read.schema(MESSAGES).parquet(outbox).repartition("digest").sortWithinPartitions("digest", "seq")
        rows.mapInArrow(send, ACKS).write.mode("overwrite").parquet(acks)
        killed_at("sent")
        draft = self._hadoop.Path(f"{self.path}/manifest/.{number}")
        self._fs.create(draft, True).close()
        if not self._fs.rename(draft, self._hadoop.Path(f"{self.path}/manifest/{number}")) and not self._there("manifest", str(number)):
            raise OSError(f"batch {number} could not be committed")
        killed_at("committed")

    def delivered(self) -> DataFrame:
        """digest, seq, item_ids, batch of what was taken, of whole batches."""
        status = self._fs.globStatus(self._hadoop.Path(f"{self.path}/manifest/[0-9]*")) or []
        folders = [f"{self.path}/acks/batch={s.getPath().getName()}" for s in status]
        schema = f"{ACKS}, batch bigint"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/acks").parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def mark_sent(items: DataFrame, delivered: DataFrame) -> DataFrame:
    """Items with `sent` for those that delivered messages carry."""
    ids = delivered.select(F.explode("item_ids").alias("id")).distinct()
    out = items.join(ids.withColumn("_now", F.lit(True)), "id", "left")
    return out.withColumn("sent", F.col("sent") | F.coalesce("_now", F.lit(False))).drop("_now")
