"""What the corpus operators share: tables in the shared folder, row keys, Arrow buffers, places of rows.

Nothing here collects data that grows with the corpus: what reaches the driver are counts, a number
of rows for each input file (as many as the driver lists anyway), and bitmaps whose size has a fixed
upper bound (`GROUP_BLOCKS`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.graph import shared_folder

#: The white space of the contracts: space and U+0009 to U+000D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Rows and bytes handed to Python at once; texts are processed in slices of at most SLICE_BYTES.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
SLICE_BYTES = 512 << 10
#: Bytes of a text whose words are looked for at once.
SEGMENT = 512 << 10
#: A block of a file is 2 ** BLOCK_BITS rows; a group of files has fewer than 2 * GROUP_BLOCKS blocks, of 600 bytes each.
BLOCK_BITS = 12
GROUP_BLOCKS = 16_384

_tables: list[str] = []


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/newsloom-{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _tables:
        _tables.remove(folder)


def drop_table(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/newsloom-" in folder:
                _delete(df.sparkSession, folder)


class Scratch:
    """with Scratch(spark) as scratch: tables written inside are deleted at the end, but for those of scratch.keep()."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> Scratch:
        self.before = list(_tables)
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        self.before.append(_tables[-1])
        return out

    def __exit__(self, *_: object) -> None:
        for folder in [t for t in _tables if t not in self.before]:
            _delete(self.spark, folder)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """Two longs that identify a row of a file-based table, the same in every scan, whatever its columns are called."""
    place = df.metadataColumn("_metadata")
    return F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_row")


def file_based(df: DataFrame) -> DataFrame:
    """df itself where its rows have file positions, else a Parquet copy of it."""
    try:
        df.select(*row_key(df)).schema
        return df
    except AnalysisException:
        return materialise(df, "rows")


class Places:
    """A set of rows of a file-based table: a bitmap for each block of each file that has some.

    Which rows belong is told where they are scanned, by a join with the broadcast bitmaps, so neither
    these rows nor any others move. A broadcast holds the bitmaps of one group of files, whose size is
    bounded; groups follow one another, each a scan of its own files only. places: _file, _row.
    """

    def __init__(self, docs: DataFrame, places: DataFrame) -> None:
        self.docs = docs
        bit = F.expr("shiftleft(1L, CAST(_row & 63 AS INT))")
        words = places.select("_file", F.shiftright("_row", 6).alias("w"), bit.alias("m")).groupBy("_file", "w").agg(F.bit_or("m").alias("m"))
        entry = F.struct(F.col("w").bitwiseAND(F.lit(2 ** (BLOCK_BITS - 6) - 1)).cast("int").alias("k"), "m")
        blocks = words.groupBy("_file", F.shiftright("w", BLOCK_BITS - 6).alias("_block")).agg(F.map_from_entries(F.collect_list(entry)).alias("map"))  # a block's words, 64 at most
        dense = F.transform(F.sequence(F.lit(0), F.lit(2 ** (BLOCK_BITS - 6) - 1)), lambda k: F.coalesce(F.try_element_at("map", k), F.lit(0).cast("bigint")))
        self.blocks = materialise(blocks.select("_file", "_block", dense.alias("words")), "places")
        per_file = self.blocks.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.min("_block").alias("a"), F.max("_block").alias("z")).orderBy("_file").collect()
        self.groups: list[list[tuple[int, int | None]]] = [[]]  # (file, its first block, or None for the whole file)
        held = 0
        for r in per_file:
            pieces = [None] if r.n <= GROUP_BLOCKS else list(range(r.a, r.z + 1, GROUP_BLOCKS))
            for start in pieces:
                n = min(r.n, GROUP_BLOCKS)
                if held and held + n > GROUP_BLOCKS:
                    self.groups.append([])
                    held = 0
                self.groups[-1].append((r._file, start))
                held += n

    @staticmethod
    def _pieces(group: list[tuple[int, int | None]]) -> Column:
        """Whether a row's _file and _block are in the group. Only files of the group are read."""
        out = F.col("_file").isin([f for f, start in group if start is None])
        for f, start in group:
            if start is not None:
                out = out | ((F.col("_file") == f) & F.col("_block").between(start, start + GROUP_BLOCKS - 1))
        return out

    def _scan(self, columns: list[Column]) -> DataFrame:
        return self.docs.select(*columns, *row_key(self.docs)).withColumn("_block", F.shiftright("_row", BLOCK_BITS))

    def _marked(self, scan: DataFrame, blocks: DataFrame, how: str) -> tuple[DataFrame, Column]:
        word = F.get("words", F.shiftright("_row", 6).bitwiseAND(F.lit(2 ** (BLOCK_BITS - 6) - 1)).cast("int"))
        both = scan.join(F.broadcast(blocks), ["_file", "_block"], how)
        return both, F.getbit(word, F.col("_row").bitwiseAND(F.lit(63)).cast("int")) == 1

    def rows(self, columns: list[Column]) -> Iterator[DataFrame]:
        """Of each group, columns and _file, _row of the rows that belong."""
        for group in self.groups:
            mine = self._pieces(group)
            both, inside = self._marked(self._scan(columns).filter(mine), self.blocks.filter(mine), "inner")
            yield both.filter(inside).drop("_block", "words")

    def gather(self, columns: list[Column], work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """work(rows) of all groups, as one written table."""
        path, schema = _new_path(self.docs.sparkSession, name), None
        for rows in self.rows(columns):
            out = work(rows)
            schema = out.schema
            out.write.mode("append").parquet(path)
        drop_table(self.blocks)
        return self.docs.sparkSession.read.schema(schema).parquet(path)

    def others(self, columns: list[Column]) -> Iterator[DataFrame]:
        """As rows(), of the rows that don't belong."""
        groups: list = self.groups if len(self.groups) > 1 else [None]
        for group in groups:
            mine = F.lit(True) if group is None else self._pieces(group)
            both, inside = self._marked(self._scan(columns).filter(mine), self.blocks.filter(mine), "left")
            yield both.filter(~F.coalesce(inside, F.lit(False))).drop("_block", "words")
        if len(groups) > 1:
            yield self._scan(columns).filter(~self._pieces([p for g in groups for p in g])).drop("_block")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but those at the places of gone (_file, _row). Rows stay where they are."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    parts = list(Places(docs, gone).others([record]))
    if len(parts) == 1:
        return parts[0].select("record.*")
    path = _new_path(docs.sparkSession, "kept")
    for part in parts:
        part.select("record.*").write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def binary_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string Arrow array, without copying; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces whose texts take about `most` bytes; a longer text is alone in its piece."""
    if not batch.num_rows:
        return
    _, at = binary_values(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
#: Powers of a base that are kept for the next batch.
KEPT_POWERS = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n, or more."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up = np.full(n, base, np.uint64)
        up[0] = 1
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n <= KEPT_POWERS:
            _POWERS[base] = have
    return have


def _finish(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix64(raw + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class RangeHash:
    """64-bit hashes of any ranges of a sequence of uint64 values, from prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int = BASE) -> None:
        up, self.down = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _finish((self.sums[end] - self.sums[start]) * self.down[start], end - start)


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(ASCII_SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of many texts at once: byte ranges, hashes, and each text's range of words.

    Bytes are looked at SEGMENT by SEGMENT, so what a text takes besides its bytes is 24 bytes a word.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False) -> None:
        base, top = int(at[0]), int(at[-1])
        self.body = body = raw[base:top]
        cuts = np.unique(at[1:-1] - base)  # words also end where a text ends
        starts, ends, sums = [], [], []
        for lo in range(0, len(body), SEGMENT):
            part = body[lo : lo + SEGMENT]
            if lower:
                part = _LOWER[part]
            a, z = np.searchsorted(cuts, [lo, lo + len(part)])
            self._segment(lo, part, cuts[a:z] - lo, bool(lo in cuts[a : a + 1]), starts, ends, sums)
        empty = np.zeros(0, np.int64)
        self.start = np.concatenate(starts) if starts else empty
        self.end = np.concatenate(ends) if ends else empty
        self.first = np.searchsorted(self.start, at - base)  # of each text, and the end of the last
        whole = np.concatenate(sums) if sums else np.zeros(0, np.uint64)
        self.hash = _finish(whole, self.end - self.start)

    @staticmethod
    def _segment(lo: int, part: np.ndarray, cut: np.ndarray, cut_before: bool, starts: list, ends: list, sums: list) -> None:
        inside = ~_IS_SPACE[part]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[cut] = inside[cut]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        cut = cut[cut > 0]
        finish[cut - 1] = inside[cut - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        if not len(s):
            return
        size = e - s
        where = np.cumsum(size) - size
        power, _ = _powers(BASE, int(size.max()) + 1)
        value = _BYTE_VALUES[part[inside]] * power[np.arange(int(size.sum())) - np.repeat(where, size)]
        total = np.add.reduceat(value, where)
        s, e = s + lo, e + lo
        if starts and not cut_before and s[0] == lo == ends[-1][-1]:  # a word that the border cuts in two
            before = int(ends[-1][-1] - starts[-1][-1])
            joined = (int(sums[-1][-1]) + int(total[0]) * pow(BASE, before, 1 << 64)) % (1 << 64)
            sums[-1][-1], ends[-1][-1] = np.uint64(joined), e[0]
            s, e, total = s[1:], e[1:], total[1:]
        if len(s):
            starts.append(s)
            ends.append(e)
            sums.append(total)


def whole_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by a column of long, regrouped so that no run of equal values is cut; with the runs' edges."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        value = table[column].to_numpy()
        return table, np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))

    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(column).to_numpy()
        cut = int(np.flatnonzero(value == value[-1])[0])
        if held and (cut or held[-1].column(column)[0].as_py() != value[-1]):
            if cut:
                held.append(batch.slice(0, cut))
            yield out()
            held = []
        elif cut:
            held.append(batch.slice(0, cut))
            yield out()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield out()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
