"""Exact deduplication with a log-structured merge index.

Shape of the index on Spark:

* memtable: each task normalises and digests its texts (`flush`); a full memtable is flushed as a
  run sorted by digest. Runs are a Parquet table in the shared folder.
* compaction: runs merge into one level by an aggregation on the digest with map-side combine, so a
  digest that a third of all rows share is one row of each task before the shuffle. The entry that
  stays is the longest original text, then the smallest identifier.
* filters: for each block of a file, a bitmap of its rows whose digest the level has (`Places`). The
  texts of all other rows, which are single, are never read again and never move.
* verification: texts that the filters let through are compared byte by byte, inside a memtable first
  (one representative of each digest and content leaves a task), then across tasks by grouping on
  the bytes themselves. Digests with different contents are regrouped on the contents.

Defined results: a null text counts as empty; equal texts without a doc_id rank after those with
one; of fully equal rows exactly one is kept; an empty table gives no rows; other columns are not
read. Text lengths are unbounded (a memtable holds at least one text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import ASCII_SPACE, Places, Scratch, documents, file_based, materialise, row_key, small_batches, without

#: Entries of a memtable before it is flushed as a run, and bytes of text held for verification.
MEMTABLE_ROWS = 50_000
MEMTABLE_BYTES = 32 << 20


def normalise(text: bytes | None) -> bytes:
    return (text or b"").translate(None, ASCII_SPACE)


def _digest(sha: bytes, size: int) -> bytes:
    return sha[:size]


def flush(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Memtables of digests, each flushed in digest order."""
    table: list[tuple] = []

    def run() -> pa.RecordBatch:
        table.sort(key=lambda x: x[0])
        cols = list(zip(*table, strict=True))
        out = pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
            names=["digest", "sha", "doc_id", "points", "_file", "_row"],
        )
        table.clear()
        return out

    for batch in batches:
        ids, points, files, rows = (batch.column(c).to_pylist() for c in ("doc_id", "points", "_file", "_row"))
        for i, text in enumerate(batch.column("body")):
            sha = hashlib.sha256(normalise(text.as_py())).digest()
            table.append((_digest(sha, size), sha, ids[i], points[i], files[i], rows[i]))
        if len(table) >= MEMTABLE_ROWS:
            yield run()
    if table:
        yield run()


def representatives(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One row for each digest and content that a memtable has seen."""
    seen: dict[bytes, set[bytes]] = {}
    held = 0

    def run() -> pa.RecordBatch:
        pairs = [(d, t) for d in sorted(seen) for t in seen[d]]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["digest", "norm"])

    for batch in batches:
        for text in batch.column("body"):
            norm = normalise(text.as_py())
            known = seen.setdefault(_digest(hashlib.sha256(norm).digest(), size), set())
            if norm not in known:  # compares bytes
                known.add(norm)
                held += len(norm)
            if held >= MEMTABLE_BYTES:
                yield run()
                seen.clear()
                held = 0
    if seen:
        yield run()


class ExactIndex:
    """index = ExactIndex(docs); index.members: a row of each input row with its group."""

    def __init__(self, docs: DataFrame, digest_bytes: int = 32) -> None:
        spark = docs.sparkSession
        small_batches(spark)
        self.docs = file_based(docs)
        self.size = size = digest_bytes
        scan = self.docs.select("doc_id", F.length(_text()).cast("long").alias("points"), _text().cast("binary").alias("body"), *row_key(self.docs))
        with Scratch(spark) as scratch:
            runs = materialise(scan.mapInArrow(lambda it: flush(it, size), "digest binary, sha binary, doc_id long, points long, _file long, _row long"), "runs")
            self.entries = scratch.keep(runs.join(self._compact(runs, "digest"), "digest", "left"), "entries")
            reps = Places(self.docs, self.entries.filter("size IS NOT NULL")).gather([_text().cast("binary").alias("body")], lambda rows: rows.select("body").mapInArrow(lambda it: representatives(it, size), "digest binary, norm binary"), "hits")
            mixed = scratch.keep(reps.groupBy("digest", "norm").agg(F.lit(1).alias("one")).groupBy("digest").count().filter("count > 1").select("digest"), "mixed")
        #: Digests whose texts differ; None if there are none.
        self.mixed = None if mixed.isEmpty() else mixed

    @staticmethod
    def _compact(rows: DataFrame, *key: str) -> DataFrame:
        """Groups of more than one row, with the row that stays."""
        rank = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "_file", "_row")
        return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.min(rank).alias("best")).filter("size > 1")

    @property
    def members(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256, _file, _row: one row for each input row."""
        out = self.entries
        if self.mixed is not None:
            out = out.join(self.mixed, "digest", "left_anti").unionByName(self._by_content())
        kept = F.col("size").isNull() | ((F.col("best._file") == F.col("_file")) & (F.col("best._row") == F.col("_row")))
        return out.select(
            "doc_id",
            F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
            F.coalesce(F.col("size"), F.lit(1)).cast("long").alias("group_size"),
            kept.alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            "_file", "_row",
        )

    def _by_content(self) -> DataFrame:
        """The rows of digests with different texts, grouped by the texts themselves."""
        size = self.size
        norm = F.translate(_text(), ASCII_SPACE.decode(), "").cast("binary")
        columns = [F.col("doc_id"), F.length(_text()).cast("long").alias("points"), norm.alias("norm")]
        rows = Places(self.docs, self.entries.join(self.mixed, "digest", "left_semi")).gather(columns, lambda rows: rows, "mixed-texts")
        rows = rows.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("digest", F.substring("sha", 1, size))
        return rows.join(self._compact(rows, "digest", "norm"), ["digest", "norm"], "left").drop("norm")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def exact_dedup(docs: DataFrame) -> DataFrame:
    return ExactIndex(docs).members.drop("_file", "_row")


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns."""
    index = ExactIndex(docs)
    gone = index.members.filter(~F.col("kept")).select("_file", "_row")
    return without(index.docs, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(translate(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
QUERIES = {"op2_exact_dedup": query}
ORACLES = {"op2_exact_dedup": ORACLE}
