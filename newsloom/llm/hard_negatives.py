"""Hard negatives by exact maximum inner product search over rotated vectors.

Components become integers (floor(256 x)). An orthogonal rotation, the eigenvectors of the vectors'
second moments, puts most of their energy first. A dot product is added up over a few blocks of
leading components; what the rest can still add is bounded by the norms of the two remainders
(Cauchy-Schwarz) plus slack for rounding, and a pair that can't get into a list any more is dropped
before its remaining blocks are looked at. Survivors are scored by the integers themselves, so results
are exact whatever the rotation is.

Rows are dealt to parts of at most PART_CELLS components; every anchor visits each part. A task holds
one part and streams the anchors by, so its memory doesn't grow with either side; nothing is broadcast
or collected but the moments (LEAD ** 2 numbers of at most LENGTHS vector lengths; other lengths are
searched unrotated). Positives are searched in parts of the anchor's own label; negatives, once the
positives' scores are known, in parts of all rows. A part yields at most K rows for each list; the
best of all parts are picked by a window whose limit Spark applies before it shuffles.

Defined results: rows with a null label or vector, or a component that is null, not finite, or not
finite times 256, take no part; a row's label is changed where its vec_id is divisible by 7; a null
vec_id is never an anchor, and last among equal scores; of repeated rows each counts, an anchor's copy
is another row; vectors of different lengths never meet, empty ones have score 0 with each other;
scores beyond the range of a long (components near 1e9 and more) are computed with unbounded integers
and count as the end of the range. Columns that aren't named here are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, documents, materialise, small_batches

SCALE = 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's share of the positive's score, in percent.
LEAST, MOST = 30, 90
#: Components of one part's vectors.
PART_CELLS = 1 << 22
#: Parts there are at least, as long as they have SMALL rows.
SMALL = 1024
#: Components that are rotated, and vector lengths with a rotation of their own.
LEAD, LENGTHS = 1024, 4
MOMENT_ROWS = 64
#: Rows of a part and anchors that meet at once.
TILE, BATCH = 2048, 256
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def _valid(values: np.ndarray, sizes: np.ndarray, lists: np.ndarray) -> np.ndarray:
    ok = np.append(np.isfinite(values * SCALE), True)
    start = np.cumsum(sizes) - sizes
    each = np.logical_and.reduceat(ok, start) if len(sizes) else np.zeros(0, bool)
    return np.where(sizes > 0, each, True) & lists


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = b.column("vector")
        sizes = pc.list_value_length(column).fill_null(0).to_numpy().astype(np.int64)
        with np.errstate(all="ignore"):
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.flatnonzero(_valid(x, sizes, column.is_valid().to_numpy(zero_copy_only=False)))
        kept = pa.array(good)
        vectors = column.take(kept)
        q = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE) + 0.0
        edges = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("vec_id").take(kept), b.column("label").take(kept), pa.array(sizes[good].astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges), pa.array(q))], names=["vec_id", "label", "dim", "q"])


def _rows(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, band, value: MOMENT_ROWS rows of the sum of q qT, of each length of `batches`."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims):
            x = _rows(b.column("q").filter(pa.array(dims == d)))[:, :LEAD]
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)  # directions count, not lengths
            total[int(d)] = total.get(int(d), 0) + x.T @ x
    for d, m in total.items():
        bands = range(0, len(m), MOMENT_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([d] * len(bands), pa.int32()), pa.array(list(bands), pa.int32()), pa.array([m[k : k + MOMENT_ROWS].tobytes() for k in bands], pa.binary())], names=["dim", "band", "value"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by dim and band, added up as they stream by."""
    now, total = None, None
    out: list[tuple[int, int, bytes]] = []
    for b in batches:
        for d, k, v in zip(b.column("dim").to_pylist(), b.column("band").to_pylist(), b.column("value"), strict=True):
            value = np.frombuffer(v.as_buffer(), np.float64)
            if now == (d, k):
                total = total + value
            else:
                if now:
                    out.append((*now, total.tobytes()))
                now, total = (d, k), value
    if now:
        out.append((*now, total.tobytes()))
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["dim", "band", "value"])


def rotations(points: DataFrame) -> dict[int, np.ndarray]:
    """Of the LENGTHS most frequent vector lengths, eigenvectors of the second moments, the greatest first."""
    lengths = [r.dim for r in points.filter("dim > 1").groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(LENGTHS).collect()]
    schema = "dim int, band int, value binary"
    sums = points.filter(F.col("dim").isin(lengths)).select("dim", "q").mapInArrow(_partial_moments, schema)
    sums = sums.repartition("dim", "band").sortWithinPartitions("dim", "band").mapInArrow(_summed, schema)
    bands: dict[int, list] = {}
    for r in sums.orderBy("dim", "band").collect():  # LEAD ** 2 numbers of each of LENGTHS lengths at most
        bands.setdefault(r.dim, []).append(np.frombuffer(r.value, np.float64))
    out = {}
    for d, parts in bands.items():
        m = np.concatenate(parts).reshape(min(d, LEAD), -1)
        out[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def cuts_of(dim: int) -> list[int]:
    """Ends of the blocks of leading components."""
    return sorted({max(1, dim * k // 8) for k in (1, 2, 4, 6)} | {dim}) if dim else [0]


class Rotated:
    """Vectors with their rotation, the norms of what remains after each block, and the integers."""

    def __init__(self, q: np.ndarray, rotation: np.ndarray | None) -> None:
        self.q = q
        self.x = q
        if rotation is not None and q.shape[1]:
            k = len(rotation)
            self.x = np.concatenate([q[:, :k] @ rotation, q[:, k:]], axis=1)
        dim = q.shape[1]
        self.cuts = cuts_of(dim)
        self.norm = np.linalg.norm(q, axis=1) if dim else np.zeros(len(q))
        self.rest = [np.linalg.norm(self.x[:, c:], axis=1) for c in self.cuts]
        self.slack = 64 * (dim + 8) * 2.0**-53

    def take(self, rows: slice) -> Rotated:
        out = object.__new__(Rotated)
        out.q, out.x, out.cuts, out.norm, out.slack = self.q[rows], self.x[rows], self.cuts, self.norm[rows], self.slack
        out.rest = [r[rows] for r in self.rest]
        return out


def surviving(a: Rotated, b: Rotated, low: np.ndarray, high: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product, its error bound) of the pairs of `live` whose product may lie in [low[i], high[i]]."""
    loose = a.slack * a.norm
    partial = np.zeros(live.shape)
    i = j = None
    s = np.zeros(0)
    start = 0
    for level, end in enumerate(a.cuts):
        if i is None:
            partial += a.x[:, start:end] @ b.x[:, start:end].T
            room = np.outer(a.rest[level], b.rest[level]) + np.outer(loose, b.norm)
            live = live & (partial + room >= low[:, None]) & (partial - room <= high[:, None])
            if np.count_nonzero(live) * 8 < live.size or level == len(a.cuts) - 1:
                i, j = np.nonzero(live)
                s = partial[i, j]
        else:
            s = s + np.einsum("nd,nd->n", a.x[i, start:end], b.x[j, start:end])
            room = a.rest[level][i] * b.rest[level][j] + loose[i] * b.norm[j]
            keep = (s + room >= low[i]) & (s - room <= high[i])
            i, j, s = i[keep], j[keep], s[keep]
        start = end
    return i, j, s, loose[i] * b.norm[j]


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the pairs: in longs, or in unbounded integers where longs could overflow; these end at the range of a long."""
    if not a.shape[1]:
        return np.zeros(len(i), np.int64)
    most_a, most_b = max(np.abs(a).max(initial=0.0), 1.0), max(np.abs(b).max(initial=0.0), 1.0)
    if most_a < 2.0**62 and most_b < 2.0**62 and most_a * most_b * a.shape[1] < 2.0**62:
        step = max(1, PART_CELLS // a.shape[1])
        return np.concatenate([np.zeros(0, np.int64), *[np.einsum("nd,nd->n", a[i[k : k + step]].astype(np.int64), b[j[k : k + step]].astype(np.int64)) for k in range(0, len(i), step)]])
    whole = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in b]
    sums = (sum(p * q for p, q in zip(whole[0][x], whole[1][y], strict=True)) for x, y in zip(i, j, strict=True))
    return np.array([min(max(v, LOWEST), HIGHEST) for v in sums], np.int64)


def best(anchors: Rotated, part: Rotated, own: np.ndarray, nodes: np.ndarray, labels: np.ndarray, other: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, row, score) of the `most` best rows of each list.

    Lists of an anchor are intervals low[anchor, l] to high[anchor, l] of scores, low > high for none. Rows come
    in order of preference, so of equal scores the earlier rows win and a full list needs a greater score.
    """
    n, width = low.shape
    need = low.copy()
    slot, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for t in range(0, len(nodes), TILE):
        tile = slice(t, t + TILE)
        here = part.take(tile)
        live = (labels[:, None] == other[None, tile]) == same
        live &= own[:, None] != nodes[None, tile]
        open_ = need <= high
        live &= open_.any(1)[:, None]
        if not live.any():
            continue
        least, greatest = np.where(need == LOWEST, -np.inf, need), np.where(high == HIGHEST, np.inf, high)
        i, j, s, error = surviving(anchors, here, np.where(open_, least, np.inf).min(1), np.where(open_, greatest, -np.inf).max(1), live)
        fits = open_[i] & (s[:, None] + error[:, None] >= least[i]) & (s[:, None] - error[:, None] <= greatest[i])
        some = fits.any(1)
        i, j, fits = i[some], j[some], fits[some]
        exact = products(anchors.q, here.q, i, j)
        k, l = np.nonzero(fits & (exact[:, None] >= need[i]) & (exact[:, None] <= high[i]))
        if not len(k):
            continue
        slot, row, score = np.append(slot, i[k] * width + l), np.append(row, j[k] + t), np.append(score, exact[k])
        order = np.lexsort((row, ~score, slot))
        slot, row, score = slot[order], row[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < most
        slot, row, score, rank = slot[keep], row[keep], score[keep], rank[keep]
        full = rank == most - 1
        need.reshape(-1)[slot[full]] = np.minimum(score[full], HIGHEST - 1) + 1
    return slot, row, score


FOUND = "anchor long, anchor_id long, list int, node long, vec_id long, score long"


def _searched(batches: Iterator[pa.RecordBatch], keys: list[str], turn: dict[int, np.ndarray], same: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of a part's rows, in order of preference, and then the anchors that visit it."""
    run, held = None, []
    part = None
    for whole in batches:
        if not whole.num_rows:
            continue
        place = np.stack([whole.column(c).to_numpy() for c in [*keys, "part", "side"]])
        sides = place[-1]
        edges = np.concatenate([[0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1, [len(sides)]])
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            b = whole.slice(s, e - s)
            if run is None or (place[:-1, s] != run).any():
                run, held, part = place[:-1, s], [], None
            if not sides[s]:
                held.append(b)
                continue
            if part is None:
                if not held:
                    continue
                rows = pa.Table.from_batches(held).combine_chunks()
                dim = rows["dim"][0].as_py()
                part = Rotated(_rows(rows["q"].combine_chunks()), turn.get(dim)), rows["node"].to_numpy(), rows["label"].to_numpy(), rows["vec_id"].combine_chunks()
                held = [rows.slice(0, 1).to_batches()[0]]
            tree, nodes, labels, ids = part
            for k in range(0, b.num_rows, BATCH):
                c = b.slice(k, BATCH)
                anchors = Rotated(_rows(c.column("q")), turn.get(dim))
                n = c.num_rows
                if same:
                    low, high = np.full((n, 1), LOWEST), np.full((n, 1), HIGHEST)
                else:  # lists of the positives' scores, each an interval
                    lists = c.column("positives").to_pylist()
                    low, high = np.full((n, POSITIVES), HIGHEST), np.full((n, POSITIVES), LOWEST)
                    for x, scores in enumerate(lists):
                        for y, p in enumerate(scores):
                            low[x, y], high[x, y] = -(-LEAST * p // 100), MOST * p // 100
                own = c.column("node").to_numpy()
                slot, row, score = best(anchors, tree, own, nodes, c.column("label").to_numpy(), labels, same, low, high, most)
                width = low.shape[1]
                at = pa.array(slot // width)
                yield pa.RecordBatch.from_arrays([c.column("node").take(at), c.column("vec_id").take(at), pa.array((slot % width).astype(np.int32)), pa.array(nodes[row]), ids.take(pa.array(row)), pa.array(score)], names=[x.split()[0] for x in FOUND.split(", ")])


class HardNegatives:
    def __init__(self, vectors: DataFrame) -> None:
        spark = self.spark = vectors.sparkSession
        small_batches(spark)
        label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long").alias("label")
        rows = vectors.filter("label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col("embedding").cast("array<double>").alias("vector"))
        points = rows.mapInArrow(_quantised, "vec_id long, label long, dim int, q array<double>")
        self.points = materialise(points.select(F.monotonically_increasing_id().alias("node"), "*"), "points")
        self.turn = rotations(self.points)
        self.least_parts = 4 * spark.sparkContext.defaultParallelism

    def _visits(self, anchors: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of each part (side 0), and the anchors of the part's keys after them (side 1), parts as runs."""
        size = F.count(F.lit(1))
        cells = F.ceil(size * F.greatest(F.first("dim"), F.lit(1)) / PART_CELLS)
        parts = self.points.groupBy(*keys).agg(F.greatest(cells, F.least(F.lit(self.least_parts), F.ceil(size / SMALL))).cast("int").alias("parts"))
        parts = materialise(parts, "parts")
        none = F.lit(None).cast("array<long>").alias("positives")
        columns = ["node", "vec_id", "label", "dim", "q"]
        mine = self.points.join(parts, keys).select(*keys, *[c for c in columns if c not in keys], none, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"))
        theirs = anchors.join(parts, keys).select(*keys, *[c for c in columns if c not in keys], "positives", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"))
        both = mine.unionByName(theirs).withColumn("run", F.xxhash64(*keys, "part"))
        both = both.select("run", *keys, "part", "side", *[c for c in columns if c not in keys], "positives")
        return both.repartition("run").sortWithinPartitions("run", *keys, "part", "side", F.col("vec_id").asc_nulls_last(), "node")

    def _found(self, anchors: DataFrame, keys: list[str], same: bool, most: int) -> DataFrame:
        turn = self.turn
        found = self._visits(anchors, keys).mapInArrow(lambda it: _searched(it, keys, turn, same, most), FOUND)
        w = Window.partitionBy("anchor", "list").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "node")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)

    def positives(self) -> DataFrame:
        """anchor, anchor_id, node, vec_id, score, rank of each anchor's best rows of its label."""
        anchors = self.points.filter(F.col("vec_id") % ANCHOR_EVERY == 0)
        return self._found(anchors.withColumn("positives", F.lit(None).cast("array<long>")), ["dim", "label"], True, POSITIVES)

    def negatives(self, positives: DataFrame) -> DataFrame:
        """anchor, list (rank of the positive, from 0), vec_id, score, rank of the rows of other labels in each positive's interval."""
        scores = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))  # POSITIVES at most
        anchors = self.points.join(scores, self.points.node == scores.anchor).withColumn("positives", F.col("p.score")).drop("anchor", "p")
        return self._found(anchors, ["dim"], False, NEGATIVES)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    with Scratch(vectors.sparkSession) as scratch:
        search = HardNegatives(vectors)
        positives = materialise(search.positives(), "positives")
        negatives = search.negatives(positives)
        named = positives.select("anchor", (F.col("rank") - 1).alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = negatives.join(named, ["anchor", "list"])
        return scratch.keep(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(documents(spark, sf_dir, "embeddings"))


QUERIES = {"op12_hard_negatives": query}
ORACLES = {
    "op12_hard_negatives": f"""
WITH p AS (
  SELECT row_number() OVER () AS node, vec_id, CAST(CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.node AS anchor, a.vec_id AS anchor_id, b.node, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM p a JOIN p b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.node <> b.node AND len(a.q) = len(b.q)),
g AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, node) AS n FROM s WHERE same),
f AS (SELECT g.anchor_id, g.vec_id AS positive_id, g.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY g.anchor, g.n ORDER BY s.score DESC, s.vec_id NULLS LAST, s.node) AS rank
      FROM g JOIN s ON s.anchor = g.anchor AND NOT s.same AND {LEAST} * g.score <= 100 * s.score AND 100 * s.score <= {MOST} * g.score
      WHERE g.n <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM f WHERE rank <= {NEGATIVES}"""
}
