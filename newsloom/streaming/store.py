"""The store of posts: folders by day of storing, so that lookups are pruned and old days go at once.

    <path>/day=2024-01-09/part=<stream>-<batch>/*.parquet    what a micro-batch stored
    <path>/day=2024-01-09/part=all-<id>/*.parquet            a day's parts in few files
    <path>/_commits/2024-01-09_<id>                          names of the parts that all-<id> replaces

A micro-batch overwrites its own folder alone (dynamic partition overwrite), on the day on which it was
first written, so writing it again replaces it. A compaction counts from the moment its commit file is
there, which a rename puts into place whole: before, readers skip what it wrote; from then on they skip
what it replaced. Wherever it is killed, readers see each post once, and the next one sweeps up. One
compaction runs at a time. The driver lists folders, not files: a folder for each day and compacted
part, and those of the batches since.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS = "message_id STRING, source_id BIGINT, published_at TIMESTAMP, late BOOLEAN, stored_at TIMESTAMP"
ALL = "all-"
#: Rows of a file of a compacted day.
FILE_ROWS = 4_000_000


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    def _names(self, *pattern: str) -> list[str]:
        return [s.getPath().getName() for s in (self._fs.globStatus(self._at(*pattern)) or [])]

    def _commits(self) -> dict[tuple[str, str], set[str]]:
        """(day, id) of finished compactions: the parts each replaced."""
        out = {}
        for name in self._names("_commits", "[0-9]*"):
            stream = self._fs.open(self._at("_commits", name))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out[tuple(name.split("_", 1))] = set(text.split())
        return out

    def parts(self) -> dict[str, list[str]]:
        """day: the parts that count."""
        commits = self._commits()
        out: dict[str, list[str]] = {}
        for status in self._fs.globStatus(self._at("day=*", "part=*")) or []:
            place = status.getPath()
            day, part = place.getParent().getName()[4:], place.getName()[5:]
            if part.startswith(ALL) and (day, part[len(ALL) :]) not in commits:
                continue  # a compaction that never finished
            if any(d == day and part in gone for (d, _), gone in commits.items()):
                continue
            out.setdefault(day, []).append(part)
        return out

    def read(self, since: dt.date | None = None) -> DataFrame:
        """All posts, or those stored since a day: other days are neither listed nor scanned."""
        days = {d: p for d, p in self.parts().items() if since is None or d >= since.isoformat()}
        folders = [f"{self.path}/day={d}/part={p}" for d, parts in sorted(days.items()) for p in parts]
        schema = f"{POSTS}, day DATE, part STRING"
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)
        return rows if since is None else rows.filter(F.col("day") >= F.lit(since))

    def write(self, rows: DataFrame, part: str, day: dt.date) -> None:
        """rows as a part, instead of what it was before. A part keeps the day of its first writing."""
        before = self._fs.globStatus(self._at("day=*", f"part={part}")) or []
        if before:
            day = dt.date.fromisoformat(before[0].getPath().getParent().getName()[4:])
        placed = rows.select(*[c.split()[0] for c in POSTS.split(", ")], F.lit(day).alias("day"), F.lit(part).alias("part"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "part").parquet(self.path)

    def compact(self, killed_at: Callable[[str], None] = lambda step: None) -> list[str]:
        """Days of several parts get one; what earlier compactions left goes. The days. killed_at: for tests, called at each step."""
        self._sweep()
        done = []
        for day, parts in sorted(self.parts().items()):
            if len(parts) < 2:
                continue
            name = uuid.uuid4().hex
            rows = self.spark.read.schema(POSTS).parquet(*[f"{self.path}/day={day}/part={p}" for p in parts])
            n = rows.count()
            rows.repartition(max(1, -(-n // FILE_ROWS)), "message_id").write.parquet(f"{self.path}/day={day}/part={ALL}{name}")
            killed_at("written")
            self._commit(day, name, parts)
            killed_at("committed")
            self._sweep()
            done.append(day)
        return done

    def _commit(self, day: str, name: str, parts: list[str]) -> None:
        draft = self._at("_commits", f".{name}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray("\n".join(parts).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, self._at("_commits", f"{day}_{name}")):
            raise OSError(f"compaction of {day} could not be committed")

    def _sweep(self) -> None:
        """Delete replaced parts, then commits of parts that are gone, and compactions that never finished."""
        commits = self._commits()
        for (day, _), gone in commits.items():
            for part in gone:
                self._fs.delete(self._at(f"day={day}", f"part={part}"), True)
        for status in self._fs.globStatus(self._at("day=*", f"part={ALL}*")) or []:
            place = status.getPath()
            if (place.getParent().getName()[4:], place.getName()[5 + len(ALL) :]) not in commits:
                self._fs.delete(place, True)
        for day, name in commits:
            if not self._fs.exists(self._at(f"day={day}", f"part={ALL}{name}")):
                self._fs.delete(self._at("_commits", f"{day}_{name}"), False)

    def expire(self, before: dt.date) -> list[str]:
        """Whole days before that one go, with their folders. The days."""
        old = [n for n in self._names("day=*") if n[4:] < before.isoformat()]
        for name in old:
            self._fs.delete(self._at(name), True)
        self._sweep()
        return [n[4:] for n in old]
