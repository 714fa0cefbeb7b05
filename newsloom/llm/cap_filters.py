"""Near-duplicate vectors by spherical caps: random product codes, list decoding, filter joins.

Vectors link if they have the same label and a cosine of at least THRESHOLD. Equal vectors of a label
are one class first, so copies never meet each other. Each class vector is rotated and cut into
PARTS parts; every part has M random unit codewords, and a filter direction is one codeword of each
part, M ** PARTS directions in all without storing any of them. List decoding finds all directions
whose inner product exceeds the cap's height (at least LIST_LEAST, the best ones, for every vector),
by bounding the halves of the sum. M follows from the number of classes so that unrelated vectors
hardly ever share a cap; the lists keep their length, and the probability that two vectors of cosine
0.98 share none of theirs is far below one in a thousand.

Classes of one label that share a cap are compared exactly, in double precision, by blocks: a pair is
counted at its least common cap only, so link counts are exact without a list of pairs; what leaves
a cap is one count and one edge of each member. A cap with more than TILE members is compared in
tiles, spread over tasks. Edges make components by large-star and small-star steps.

Defined results: a vector that is null, empty, zero, or has a null or non-finite component, or whose
label is null, links with nothing (0 links, a component of its own); vectors of different length
never link; null vec_ids come last when the smallest is chosen; of repeated rows each counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Places, Scratch, documents, file_based, materialise, mix64, row_key, small_batches, whole_runs
from newsloom.llm.components import components

THRESHOLD = 0.98
PARTS = 4
LIST_MEAN, LIST_LEAST = 20, 12
#: Directions for each class.
SPREAD = 30
TILE = 1024
#: Caps whose members are marked at once, when it's looked for the smallest that a pair shares.
CAPS = 4096
#: Sums of half a direction of one vector, and of all vectors decoded at once.
MOST_SUMS = 1 << 18
DECODE_CELLS = 1 << 20


def parts_of(dim: int) -> int:
    """Parts of few dimensions would have few different codewords."""
    return max(1, min(PARTS, dim // 6))


def codewords_needed(classes: int, dim: int) -> int:
    parts = parts_of(dim)
    return min(max(6, int(np.ceil((SPREAD * max(classes, 1)) ** (1 / parts)))), int(MOST_SUMS ** (1 / ((parts + 1) // 2))))


@cache
def code(dim: int, m: int) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """(rotation, codewords of each part, parts). The same on every executor."""
    rng = np.random.default_rng([dim, m, 77])
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    cuts = np.linspace(0, dim, parts_of(dim) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    words = []
    for p in parts:
        w = rng.normal(size=(m, p.stop - p.start))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return rotation, words, parts


def cap_height(dim: int, m: int) -> float:
    """Height that a random direction's inner product exceeds LIST_MEAN times in M ** parts."""
    parts = parts_of(dim)
    return NormalDist().inv_cdf(1 - min(0.4, LIST_MEAN / m**parts)) * np.sqrt(parts / dim)


def decode(unit: np.ndarray, m: int) -> list[np.ndarray]:
    """Of each unit vector, the sorted numbers of all filters whose cap it is in."""
    n, dim = unit.shape
    rotation, words, parts = code(dim, m)
    turned = unit @ rotation
    sums = [turned[:, p] @ w.T for p, w in zip(parts, words, strict=True)]
    halves = [sums[: (len(sums) + 1) // 2], sums[(len(sums) + 1) // 2 :]]
    tables = []
    for half in halves:
        table = np.zeros((n, 1))
        for s in half:
            table = (table[:, :, None] + s[:, None, :]).reshape(n, -1)
        tables.append(table)
    left, right = tables
    height = cap_height(dim, m)
    least = min(LIST_LEAST, left.shape[1] * right.shape[1])
    most_left, most_right = left.max(1), right.max(1)
    out = []
    for i in range(n):
        at = min(height, most_left[i] + most_right[i])
        while True:
            a = np.flatnonzero(left[i] >= at - most_right[i])
            b = np.flatnonzero(right[i] >= at - most_left[i])
            total = np.add.outer(left[i, a], right[i, b])
            x, y = np.nonzero(total >= at)
            if len(x) >= least:
                break
            at -= 0.08 * abs(height) + 1e-9
        if len(x) > least and at < height:  # the best ones where the cap itself has too few
            top = np.argsort(-total[x, y], kind="stable")[:least]
            x, y = x[top], y[top]
        out.append(np.sort(a[x] * right.shape[1] + b[y]))
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _rowwise(f: np.ufunc, values: np.ndarray, sizes: np.ndarray, nothing: object) -> np.ndarray:
    """f over the values of each row; rows without values give `nothing`."""
    some = sizes > 0
    out = np.full(len(sizes), nothing, values.dtype)
    if some.any():
        out[some] = f.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


KEYS = "vec_id long, _file long, _row long, good boolean, k1 long, k2 long, area long"


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row: whether its vector can link, two hashes of label and vector, and one of label and length."""
    for b in batches:
        vector = b.column("vector")
        sizes = pc.list_value_length(vector).fill_null(0).to_numpy().astype(np.int64)
        x = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero, not two
        good = _rowwise(np.logical_and, np.isfinite(x), sizes, False) & _rowwise(np.logical_or, x != 0, sizes, False) & b.column("labelled").to_numpy(zero_copy_only=False)
        place = mix64((np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64) + np.uint64(1))
        area = mix64(b.column("label").to_numpy().view(np.uint64) + mix64(sizes.astype(np.uint64)))
        keys = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            total = _rowwise(np.add, mix64((x.view(np.uint64) ^ place) * np.uint64(salt)), sizes, 0)
            keys.append(mix64(total + area * np.uint64(salt)))
        signed = lambda v: pa.array(v.view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("_file"), b.column("_row"), pa.array(good), *map(signed, keys), signed(area)], names=[c.split()[0] for c in KEYS.split(", ")])


def _decode_batches(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """_file, _row, vector, caps: sorted."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("vector")).to_numpy()
        for d in np.unique(sizes):
            rows = batch.take(pa.array(np.flatnonzero(sizes == d)))
            x = _vectors(rows.column("vector"))
            vectors = rows.column("vector")
            largest = np.abs(x).max(1, keepdims=True)
            if ((largest < 1e-120) | (largest > 1e120)).any():  # their squares would leave the range of doubles; cosines don't depend on the length
                x = x / np.where((largest < 1e-120) | (largest > 1e120), largest, 1.0)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), int(d)).cast(vectors.type)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            m = codewords_needed(classes, int(d))
            step = max(1, DECODE_CELLS // m ** ((parts_of(int(d)) + 1) // 2))
            lists = [c for i in range(0, len(x), step) for c in decode(x[i : i + step], m)]
            area = mix64(rows.column("label").to_numpy().view(np.uint64) + mix64(np.full(len(x), d, np.uint64)))
            caps = [np.sort(mix64(c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a).view(np.int64)) for c, a in zip(lists, area, strict=True)]
            edges = np.concatenate([[0], np.cumsum([len(c) for c in caps])])
            yield pa.RecordBatch.from_arrays([rows.column("_file"), rows.column("_row"), vectors, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(caps)))], names=["_file", "_row", "vector", "caps"])


def _share_lower(cap: int, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """[member, member]: whether two members are in a cap below this one together. Caps are looked at CAPS at a time."""
    lower = flat < cap
    flat, owner = flat[lower], owner[lower]
    _, code_, size = np.unique(flat, return_inverse=True, return_counts=True)
    shared = size[code_] > 1
    _, code_ = np.unique(code_[shared], return_inverse=True)
    owner = owner[shared]
    out = np.zeros((n, n), bool)
    order = np.argsort(code_, kind="stable")
    code_, owner = code_[order], owner[order]
    for lo in range(0, int(code_[-1]) + 1 if len(code_) else 0, CAPS):
        a, z = np.searchsorted(code_, [lo, lo + CAPS])
        has = np.zeros((n, CAPS), np.float32)
        has[owner[a:z], code_[a:z] - lo] = 1
        out |= (has @ has.T) > 0
    return out


def compare(cap: int, x: np.ndarray, flat: np.ndarray, owner: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(copies linked to each member counted at this cap, least linked member) of left x right. flat, owner: all caps of the members."""
    norms = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / np.outer(norms, norms) >= THRESHOLD
    near &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    np.fill_diagonal(near, False)
    n = len(x)
    if not near.any():
        return np.zeros(n, np.int64), np.arange(n)
    count = (near & ~_share_lower(cap, flat, owner, n)) @ copies  # pairs that share a smaller cap are counted there
    least = np.arange(n)
    while True:  # least member reachable by links in here
        now = np.minimum(least, np.where(near, least[None, :], n).min(1))
        now = now[now]
        if (now == least).all():
            return count, least
        least = now


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, cuts in whole_runs(batches, "run"):
        cap, node, copies, side = (table[c].to_numpy() for c in ("cap", "node", "copies", "side"))
        vectors, lists = table["vector"].combine_chunks(), table["caps"].combine_chunks()
        sizes, dims = pc.list_value_length(lists).to_numpy(), pc.list_value_length(vectors).to_numpy()
        flat, edge = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        counts, heads = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            count, head = np.zeros(e - s, np.int64), np.arange(e - s)
            if e - s > 1 and (dims[s:e] == dims[s]).all():
                owner = np.repeat(np.arange(e - s), sizes[s:e])
                count, head = compare(int(cap[s]), _vectors(vectors.slice(s, e - s)), flat[edge[s] : edge[e]], owner, copies[s:e], (side[s:e] & 1) > 0, (side[s:e] & 2) > 0)
            counts.append(count)
            heads.append(node[s:e][head])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(counts)), pa.array(np.concatenate(heads))], names=["node", "links", "head"])


class CapFilters:
    def __init__(self, vectors: DataFrame) -> None:
        spark = vectors.sparkSession
        small_batches(spark)
        table = self.table = file_based(vectors)
        kind = dict(table.dtypes)["embedding"]
        self.kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
        self.columns = [F.col("embedding").cast(self.kind).alias("vector"), F.xxhash64("label").alias("label")]
        scan = table.select("vec_id", *row_key(table), *self.columns, F.col("label").isNotNull().alias("labelled"))
        self.rows = materialise(scan.mapInArrow(_key_batches, KEYS), "keys")
        best = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "_file", "_row")).alias("best")
        grouped = self.rows.filter("good").groupBy("k1", "k2", "area").agg(best, F.count(F.lit(1)).alias("copies"))
        self.classes = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
        self.count = self.classes.count()
        with Scratch(spark) as scratch:
            found = scratch.keep(self._found(), "found")
        self.links = found.groupBy("node").agg(F.sum("links").alias("links"))
        self.labels = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")))

    def _found(self) -> DataFrame:
        """node, head, links: of each member and linked head, the links counted."""
        classes, kind = self.count, self.kind
        own = self.classes.select("node", "copies", F.col("best._file").alias("_file"), F.col("best._row").alias("_row"))

        def work(rows: DataFrame) -> DataFrame:
            decoded = rows.select("_file", "_row", "vector", "label").mapInArrow(lambda it: _decode_batches(it, classes), f"_file long, _row long, vector {kind}, caps array<long>")
            return decoded.join(own, ["_file", "_row"]).select("node", "copies", "vector", "caps")

        reps = Places(self.table, own).gather(self.columns, work, "reps")
        spread = reps.select("node", F.explode("caps").alias("cap"))
        shared = spread.groupBy("cap").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        met = spread.join(materialise(shared, "shared"), "cap")
        # a cap of many members is compared tile against tile
        tiles = F.ceil(F.col("size") / TILE).cast("int")
        met = met.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        met = met.select("cap", "node", F.xxhash64("cap", F.least("tile", "other"), F.greatest("tile", "other")).alias("run"),
                         F.when(F.col("tile") == F.col("other"), 3).when(F.col("tile") < F.col("other"), 1).otherwise(2).alias("side"))
        met = met.join(reps, "node").repartition("run").sortWithinPartitions("run")
        found = met.mapInArrow(_compare_batches, "node long, links long, head long")
        return found.groupBy("node", "head").agg(F.sum("links").alias("links"))

    @property
    def members(self) -> DataFrame:
        named = self.classes.join(self.links, "node", "left").join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = materialise(named.groupBy("component").agg(F.min("best").alias("head")), "heads")
        groups = materialise(named.join(heads, "component").select("k1", "k2", "area", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "groups")
        out = self.rows.filter("good").join(groups, ["k1", "k2", "area"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("head.vec_id").alias("component_id"))
        return out.unionByName(self.rows.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return CapFilters(vectors).members.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(documents(spark, sf_dir, "embeddings"))


QUERIES = {"op9_cap_filters": query}
