"""The life of a source as keyed state with event-time timers: outages, silences, expiry.

Failures in a row depend on the order of polls, and polls arrive out of order. So a poll waits in the
state of its source until the watermark has passed it; then the source's complete polls are told in
order of time, whatever batches they came in. A timer looks after what nobody polls any more: a silence
is told once it lasts `silent`, probed again each time it lasts that long once more, and after `expire`
the state goes, so the state holds the sources of the last days and not of all times. What is told
depends on the polls and on the clock (the watermark) alone: a restart changes nothing.

Sources are dealt to buckets by their hash. A bucket is a key of Spark's state, with one timer and its sources' polls and lives
packed into a few values: Python is asked once for each bucket and trigger, however many sources there are. A bucket's waiting
polls are those of a trigger and of the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BinaryType, LongType, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A poll that waits, and what is known of a source; a bucket's are packed one after the other.
POLL = np.dtype([("source_id", "<i8"), ("at_ms", "<i8"), ("seq", "<i8"), ("failed", "?"), ("client", "?")])
LIFE = np.dtype([("source_id", "<i8"), ("fails", "<i8"), ("last", "<i8"), ("told", "<i8")])
PACKED = StructType().add("rows", BinaryType())
ALARM = StructType().add("at_ms", LongType())
TOLD = "source_id long, kind string, at_ms long, fails long"


@dataclass(frozen=True)
class Patience:
    """Failures in a row that are an error, that the administrator hears of (of any kind, of the client's), and milliseconds."""

    error: int = 3
    alert: int = 8
    client_alert: int = 2
    silent_ms: int = 12 * 3_600_000
    expire_ms: int = 72 * 3_600_000


@dataclass
class Life:
    """What is known of a source: failures in a row, its last poll, silences told since."""

    fails: int = 0
    last: int | None = None
    told: int = 0

    def until(self, now: int, patience: Patience) -> list[tuple[str, int, int]]:
        """(kind, moment, failures) of what the silence up to now, that moment included, brings about; forgets at expiry."""
        out = []
        if self.last is None:
            return out
        while True:
            due = self.last + (self.told + 1) * patience.silent_ms
            end = self.last + patience.expire_ms
            if min(due, end) > now:
                return out
            if due >= end:
                out.append(("expired", end, self.fails))
                self.fails, self.last, self.told = 0, None, 0
                return out
            self.told += 1
            out.append(("silent" if self.told == 1 else "probe", due, self.fails))

    def poll(self, at: int, failed: bool, client: bool, patience: Patience) -> list[tuple[str, int, int]]:
        """A poll, after all that the silence before it brought about."""
        out = self.until(at - 1, patience)
        if not failed and self.fails >= patience.error:
            out.append(("revived", at, self.fails))
        self.fails = self.fails + 1 if failed else 0
        if self.fails == patience.error:
            out.append(("error", at, self.fails))
        if failed and (self.fails == patience.alert or (client and self.fails == patience.client_alert)):
            out.append(("alert", at, self.fails))
        self.last, self.told = at, 0
        return out

    def due(self, patience: Patience) -> int | None:
        """When the next thing happens if nobody polls."""
        return None if self.last is None else self.last + min((self.told + 1) * patience.silent_ms, patience.expire_ms)


#: Keys that sources are dealt to.
BUCKETS = 1024


class SourceLives(StatefulProcessor):
    """The lives of a bucket's sources. Its one timer goes off at the first moment at which one of them has something to tell."""

    def __init__(self, patience: Patience = Patience()) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lives = handle.getValueState("lives", PACKED)
        self.waiting = handle.getListState("waiting", PACKED)
        self.alarm = handle.getValueState("alarm", ALARM)

    def _wake(self, at: int | None) -> None:
        """The timer, at `at` at the latest."""
        before = self.alarm.get()[0] if self.alarm.exists() else None
        if at is not None and (before is None or at < before):
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        packed, first = [], None
        for frame in rows:
            if len(frame):
                packed.append((_packed(frame, POLL),))
                least = int(frame["at_ms"].min())
                first = least if first is None else min(first, least)
        if packed:
            self.waiting.appendList(packed)
            self._wake(first + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, patience = timerValues.getCurrentWatermarkInMs(), self.patience
        parts = [np.frombuffer(p[0], POLL) for p in self.waiting.get()] if self.waiting.exists() else []
        polls = np.concatenate(parts) if parts else np.zeros(0, POLL)
        left, polls = polls[polls["at_ms"] >= now], np.sort(polls[polls["at_ms"] < now], order=["source_id", "at_ms", "seq", "failed", "client"])
        known = np.frombuffer(self.lives.get()[0], LIFE).tolist() if self.lives.exists() else []
        lives = {source: Life(fails, last, told) for source, fails, last, told in known}
        told = []
        for source, at, _, failed, client in polls.tolist():
            life = lives.get(source)
            if life is None:
                life = lives[source] = Life()
            told += [(source, *x) for x in life.poll(at, failed, client, patience)]
        for source, life in lives.items():
            told += [(source, *x) for x in life.until(now - 1, patience)]
        rows = [(source, life.fails, life.last, life.told) for source, life in lives.items() if life.last is not None]
        if parts:
            if len(left):
                self.waiting.put([(left.tobytes(),)])
            else:
                self.waiting.clear()
        if rows:
            self.lives.update((np.array(rows, LIFE).tobytes(),))
        else:
            self.lives.clear()
        self.alarm.clear()  # it has gone off
        dues = [lives[r[0]].due(patience) for r in rows]
        self._wake(min([*dues, *left["at_ms"].tolist()], default=-1) + 1 if rows or len(left) else None)
        if told:
            yield pd.DataFrame(told, columns=["source_id", "kind", "at_ms", "fails"])

    def close(self) -> None:
        pass


def _packed(frame: pd.DataFrame, kind: np.dtype) -> bytes:
    out = np.empty(len(frame), kind)
    for name in kind.names:
        out[name] = frame[name].to_numpy()
    return out.tobytes()


def source_life(polls: DataFrame, delay: str, patience: Patience = Patience(), buckets: int = BUCKETS) -> DataFrame:
    """What happens to each source. polls: a stream of source_id, moment, seq, failed, client; undated ones tell nothing."""
    rows = polls.filter("moment IS NOT NULL AND source_id IS NOT NULL").withWatermark("moment", delay)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = rows.select(F.pmod(F.xxhash64("source_id"), F.lit(buckets)).alias("bucket"), "source_id", "moment", F.unix_millis("moment").alias("at_ms"), "seq", flag("failed"), flag("client"))
    return rows.groupBy("bucket").transformWithStateInPandas(SourceLives(patience), TOLD, "append", "EventTime")


def told(polls: DataFrame, out: str, checkpoint: str, delay: str, patience: Patience = Patience()) -> None:
    """Append what happens to sources to the Parquet files at `out`, as far as polls have arrived."""
    conf = polls.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        stream = source_life(polls, delay, patience).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
