"""Substring deduplication: every word covered by a window of WINDOW words that starts twice goes.

Level-wise doubling, where only what repeats at one length is extended to the next:

1. Length g (8 words). Each window of 35 words is represented by one g-gram in it, the one with the
   least hash (leftmost of equal ones), so equal windows have equal representatives and about one
   position in fourteen is an anchor. Neighbouring windows with the same anchor are one run, one
   row: hash of the gram, of the run's whole span, of the 2g words to the right and around, and its
   place. Grams that occur at one anchor only are done: none of their windows repeats.
2. If all runs of a gram have the same span, all their windows repeat; nothing to extend.
3. Length 2g. Of other runs, equal contexts are collapsed to one row with a count (copies of a passage
   cost one row each task from here on); windows that hold a 2g-gram occurring once are dropped.
4. Full length. A run whose context occurs twice repeats as a whole. One run of each context is
   expanded into its windows; a window that occurs once among them is unique.

Rows are (file, row position) of the scan, so texts move only where their windows are expanded and
where words are removed; other rows are told apart where they are scanned (`Places`). No key gathers
its rows in one task: counts are aggregated map-side, joins are against tables with one row of each
key. Word sequences are compared by 64-bit polynomial hashes of 64-bit word hashes, and only among
those anchored at one gram; the words themselves are not compared again.

Defined results: a null text has no words; texts shorter than a window lose nothing; equal rows of
the same doc_id count as two documents and lose everything (from 35 words on); an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import SEGMENT, Places, RangeHash, Scratch, Words, binary_values, documents, file_based, materialise, mix64, row_key, slices, small_batches

WINDOW = 35
#: Room for the place of a word in a slice; the other bits of a word order the grams.
_PLACE_BITS = 30
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Windows whose anchors are looked for at once.
STEP = 1 << 18


def gram_size(window: int) -> int:
    return min(8, max(1, window // 4))


class Runs:
    """Runs of windows with one anchor, over all texts of a slice."""

    def __init__(self, words: Words, window: int) -> None:
        n, g = len(words.start), gram_size(window)
        self.hash = RangeHash(words.hash, base=0xC2B2AE3D27D4EB4F)
        sizes = np.diff(words.first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.begin, self.end = words.first[:-1], words.first[1:]
        if n < window:
            self.valid = np.zeros(0, np.int64)
        else:
            p = np.arange(n - window + 1)
            self.valid = p[p + window <= self.end[owner[: n - window + 1]]]
        empty = np.zeros(0, np.int64)
        if not len(self.valid):
            self.first = self.last = self.anchor = self.owner = empty
            return
        anchor = np.concatenate([self._anchors(lo, min(lo + STEP, n - window + 1), window, g) for lo in range(0, n - window + 1, STEP)])[self.valid]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.valid[1:] != self.valid[:-1] + 1)
        at = np.flatnonzero(new)
        self.first = self.valid[at]
        self.last = self.valid[np.append(at[1:], len(anchor)) - 1]
        self.anchor = anchor[at]
        self.owner = owner[self.first]


    def _anchors(self, lo: int, hi: int, window: int, g: int) -> np.ndarray:
        """Of the windows that start at words lo to hi - 1, where the gram with the least hash starts."""
        at = np.arange(lo, hi + window - g)
        low = (self.hash.of(at, at + g) & ~np.uint64((1 << _PLACE_BITS) - 1)) | at.astype(np.uint64)
        width, have = window - g + 1, 1
        while 2 * have <= width:  # sliding minimum
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        return (low & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


SCAN = "doc_id long, _file long, _row long, n_words long, sha string, v long, c long, r long, l long, p0 int, n int, o int"


def joined_sha(body: bytes) -> str:
    """Digest of the words of a text joined by one space, SEGMENT by SEGMENT."""
    out, at, some = hashlib.sha256(), 0, False
    while at < len(body):
        space = _BLANK.search(body, at + SEGMENT)
        end = space.start() if space else len(body)
        words = body[at:end].split()
        if words:
            out.update(b" " * some + b" ".join(words))
            some = True
        at = end
    return out.hexdigest()


def _scan_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows: one of each document (v null), one of each run."""
    g = gram_size(window)
    for whole in batches:
        for batch in slices(whole, "body"):
            words = Words(*binary_values(batch.column("body")))
            runs = Runs(words, window)
            signed = lambda x: pa.array(x.view(np.int64))
            if len(runs.first):
                i, begin, end = runs.anchor, runs.begin[runs.owner], runs.end[runs.owner]
                span = runs.hash.of(runs.first, runs.last + window)
                right = np.where(i + 2 * g <= end, runs.hash.of(i, np.minimum(i + 2 * g, end)), np.uint64(0))
                left = np.where(i - g >= begin, runs.hash.of(np.maximum(i - g, begin), i + g), np.uint64(0))
                files, rows = (batch.column(c).take(pa.array(runs.owner)) for c in ("_file", "_row"))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(i), pa.int64()), files, rows, pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.string()),
                     signed(runs.hash.of(i, i + g)), signed(mix64(span + (i - runs.first).astype(np.uint64))), signed(right), signed(left),
                     pa.array((runs.first - begin).astype(np.int32)), pa.array((runs.last - runs.first + 1).astype(np.int32)), pa.array((i - runs.first).astype(np.int32))],
                    names=["doc_id", "_file", "_row", "n_words", "sha", "v", "c", "r", "l", "p0", "n", "o"],
                )
            count = batch.num_rows
            sha = [joined_sha(t.as_py() or b"") for t in batch.column("body")]
            none = [pa.nulls(count, pa.int64())] * 4 + [pa.nulls(count, pa.int32())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_file"), batch.column("_row"), pa.array(np.diff(words.first)), pa.array(sha, pa.string()), *none], names=["doc_id", "_file", "_row", "n_words", "sha", "v", "c", "r", "l", "p0", "n", "o"])


def _window_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of the ranges that are asked for: w, v, and the place of each."""
    for whole in batches:
        for batch in slices(whole, "body"):
            words = Words(*binary_values(batch.column("body")))
            hashes = RangeHash(words.hash, base=0xC2B2AE3D27D4EB4F)
            ranges = batch.column("ranges")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ranges.offsets.to_numpy()))
            flat = ranges.flatten()
            lo, hi, v, single = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi", "v", "single"))
            size = (hi - lo + 1).astype(np.int64)
            which = np.repeat(np.arange(len(lo)), size)
            p = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            at = words.first[owner[which]] + p
            files, rows = (batch.column(c).take(pa.array(owner[which])) for c in ("_file", "_row"))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.of(at, at + window).view(np.int64)), pa.array(v[which]), files, rows, pa.array(p.astype(np.int32)), pa.array(single[which])], names=["w", "v", "_file", "_row", "p", "single"])


def _cut_batches(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """What is left of texts with ranges to remove, and its digest."""
    for batch in batches:
        out = []
        for body, ranges in zip(batch.column("body"), batch.column("ranges"), strict=True):
            words = body.as_py().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for r in ranges.as_py():
                edge[r["lo"]] += 1
                edge[r["hi"] + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
            out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept if texts else None))
        yield pa.RecordBatch.from_arrays([batch.column("_file"), batch.column("_row"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.binary())], names=["_file", "_row", "n_removed", "kept_sha", "kept"])


class SubstringDedup:
    def __init__(self, docs: DataFrame, window: int = WINDOW) -> None:
        small_batches(docs.sparkSession)
        self.docs, self.window = file_based(docs), window
        scan = self.docs.select("doc_id", *row_key(self.docs), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
        both = materialise(scan.mapInArrow(lambda it: _scan_batches(it, window), SCAN), "runs")
        self.rows = both.filter("v is null").select("doc_id", "_file", "_row", "n_words", "sha")
        self.runs = both.filter("v is not null").select("v", "c", "r", "l", "_file", "_row", "p0", "n", "o")
        with Scratch(docs.sparkSession) as scratch:
            self.ranges = scratch.keep(self._repeated(), "ranges")

    def _texts(self, wanted: DataFrame, work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """work(rows of wanted, which has _file, _row, with their texts), as a written table."""
        body = F.col("text").cast("binary").alias("body")
        return Places(self.docs, wanted).gather([body], lambda rows: work(rows.join(wanted, ["_file", "_row"]).select("_file", "_row", "body", "ranges")), name)

    def _repeated(self) -> DataFrame:
        """_file, _row, ranges: first and last start of repeated windows of each document that has some."""
        window, g = self.window, gram_size(self.window)
        # length g
        grams = self.runs.groupBy("v").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("a"), F.max("c").alias("z")).filter("k > 1")
        grams = materialise(grams.select("v", (F.col("a") != F.col("z")).alias("differ")), "grams")
        alive = materialise(self.runs.join(grams, "v"), "alive")
        done = alive.filter("not differ").select("_file", "_row", F.col("p0").alias("lo"), (F.col("p0") + F.col("n") - 1).alias("hi"))
        # length 2 g, of one run of each context
        place = F.struct("_file", "_row", "p0", "n", "o")
        contexts = materialise(alive.filter("differ").groupBy("v", "c", "r", "l").agg(F.count(F.lit(1)).alias("k"), F.min(place).alias("at")), "contexts")
        wide = [contexts.groupBy("v", s).agg(F.sum("k").alias("sum")).filter("sum > 1").select("v", s, F.lit(True).alias(f"{s}_twice")) for s in ("r", "l")]
        level = contexts.join(wide[0], ["v", "r"], "left").join(wide[1], ["v", "l"], "left")
        anchor = F.col("at.p0") + F.col("at.o")
        lo = F.when(F.col("l_twice") & (F.col("l") != 0), F.col("at.p0")).otherwise(F.greatest(F.col("at.p0"), anchor - (g - 1)))
        hi = F.col("at.p0") + F.col("at.n") - 1
        hi = F.when(F.col("r_twice") & (F.col("r") != 0), hi).otherwise(F.least(hi, anchor - (window - 2 * g + 1)))
        level = level.select("k", "v", F.col("at._file").alias("_file"), F.col("at._row").alias("_row"), lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
        # full length
        wanted = level.groupBy("_file", "_row").agg(F.collect_list(F.struct("lo", "hi", "v", (F.col("k") == 1).alias("single"))).alias("ranges"))
        wanted = materialise(wanted, "wanted")
        windows = self._texts(wanted, lambda rows: rows.mapInArrow(lambda it: _window_batches(it, window), "w long, v long, _file long, _row long, p int, single boolean"), "windows")
        twice = windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("w", "v")
        found = windows.filter("single").join(twice, ["w", "v"], "left_semi").select("_file", "_row", F.col("p").alias("lo"), F.col("p").alias("hi"))
        copied = contexts.filter("k > 1").select("v", "c", "r", "l")
        whole = alive.filter("differ").join(copied, ["v", "c", "r", "l"], "left_semi").select("_file", "_row", F.col("p0").alias("lo"), (F.col("p0") + F.col("n") - 1).alias("hi"))
        every = done.unionByName(whole).unionByName(found)
        return every.groupBy("_file", "_row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def _cut(self, texts: bool) -> DataFrame:
        window = self.window
        return self._texts(self.ranges, lambda rows: rows.mapInArrow(lambda it: _cut_batches(it, window, texts), "_file long, _row long, n_removed long, kept_sha string, kept binary"), "cut")

    @property
    def members(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256: one row for each input row."""
        out = self.rows.join(self._cut(False).drop("kept"), ["_file", "_row"], "left")
        return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))

    @property
    def texts(self) -> DataFrame:
        """The input rows with a column `kept`: the text without the removed words; untouched texts stay as they are."""
        names = self.docs.columns
        rows = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("rec"), F.col("text").alias("own"), *row_key(self.docs))
        return rows.join(self._cut(True).select("_file", "_row", F.col("kept").cast("string").alias("cut")), ["_file", "_row"], "left").select("rec.*", F.coalesce("cut", "own").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SubstringDedup(documents(spark, sf_dir)).members


QUERIES = {"op6_substring_dedup": query}
