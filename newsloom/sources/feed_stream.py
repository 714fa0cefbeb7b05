"""Feeds as a stream whose offset is a bookmark of each feed.

Snapshots of feeds lie at `path` as feed=<name>/snapshot=<number>/<files>, as Spark writes them; numbers
of a feed ascend. The offset of a stream is the map of feeds to the last snapshot read, kept in the
stream's checkpoint: a restart goes on where each feed was, a feed that appears later begins at its
first snapshot, and one that offers nothing new costs nothing but its place in the listing. The driver
lists names only; snapshots are fetched and parsed by tasks, `slices` of them, feeds dealt by size. A
snapshot that can't be fetched or parsed is a row with `error`; the others of its task are read.

Many small feeds lie in bundles: bundle=<name>/snapshot=<number>/<files> as Spark writes JSON, a line of
each document, {"feed": ..., "document": ...}. A bundle has one bookmark, so files, listing and offset
grow with the bundles, not with the feeds. Lines are read one by one; a broken document is an error row
of its feed.

    spark.dataSource.register(FeedSource)
    spark.readStream.format("newsloom_feeds").option("path", path).load()
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from newsloom.sources.feeds import BROKEN, entries_of

SCHEMA = "feed string, snapshot long, position int, link string, title string, summary string, published string, error string"
_PLACE = re.compile(r"(?:^|/)(feed=|bundle=)([^/]+)/snapshot=(\d+)/([^/_.][^/]*)$")


@dataclass
class Slice(InputPartition):
    """(feed, snapshot, files of it) of some feeds or bundles, in order."""

    snapshots: list[tuple[str, int, list[str]]]


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"] if "://" in options["path"] or options["path"].startswith("file:/") else "file://" + options["path"]
        self.slices = int(options.get("slices", "32"))

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.uri))

    def _listed(self) -> dict[str, dict[int, list[tuple[str, int]]]]:
        """Of each feed, or bundle=name, its snapshots: files with their sizes."""
        where, root = self._files()
        out: dict[str, dict[int, list[tuple[str, int]]]] = {}
        for f in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            place = _PLACE.search(f.path) if f.type == fs.FileType.File else None
            if place:
                out.setdefault(place[1].removeprefix("feed=") + place[2], {}).setdefault(int(place[3]), []).append((f.path, f.size or 0))
        return out

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {feed: max(snapshots) for feed, snapshots in sorted(self._listed().items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Feeds with new snapshots, the largest first, each to the slice that has least so far."""
        fresh = {feed: {n: files for n, files in snapshots.items() if start.get(feed, -1) < n <= end.get(feed, -1)} for feed, snapshots in self._listed().items()}
        size = {feed: sum(s for files in mine.values() for _, s in files) for feed, mine in fresh.items() if mine}
        out = [Slice([]) for _ in range(max(1, min(self.slices, len(size))))]
        held = [0] * len(out)
        for feed in sorted(size, key=lambda f: (-size[f], f)):
            k = held.index(min(held))
            held[k] += size[feed] + 1
            out[k].snapshots += [(feed, n, sorted(p for p, _ in files)) for n, files in sorted(fresh[feed].items())]
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        where, _ = self._files()
        for feed, n, files in partition.snapshots:
            if feed.startswith("bundle="):
                yield from self._bundled(where, feed, n, files)
                continue
            try:
                entries = []
                for path in files:
                    with where.open_input_stream(path) as f:
                        entries += entries_of(f.read())
            except (OSError, *BROKEN) as problem:
                yield feed, n, None, None, None, None, None, f"{type(problem).__name__}: {problem}"
                continue
            yield from self._rows(feed, n, entries)

    @staticmethod
    def _rows(feed: str, n: int, entries: list[dict]) -> Iterator[tuple]:
        for k, e in enumerate(entries):
            yield feed, n, k, e["link"], e["title"], e["summary"], e["published"], None

    def _bundled(self, where: fs.FileSystem, bundle: str, n: int, files: list[str]) -> Iterator[tuple]:
        """Entries of a bundle's documents; what can't be fetched or is no line of a bundle is an error row of the bundle."""
        feed = bundle
        for path in files:
            try:
                with where.open_input_stream(path) as f:
                    for line in io.BufferedReader(f):
                        feed = bundle
                        try:
                            one = json.loads(line)
                            feed = one["feed"]
                            entries = entries_of(one["document"])
                        except (KeyError, TypeError, AttributeError, *BROKEN) as problem:
                            yield feed, n, None, None, None, None, None, f"{type(problem).__name__}: {problem}"
                            continue
                        yield from self._rows(feed, n, entries)
            except OSError as problem:
                yield bundle, n, None, None, None, None, None, f"{type(problem).__name__}: {problem}"

    def commit(self, end: dict) -> None:
        """Bookmarks are in the stream's checkpoint; snapshots are kept for whoever else reads them."""


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsloom_feeds"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> FeedReader:
        return FeedReader(self.options)
