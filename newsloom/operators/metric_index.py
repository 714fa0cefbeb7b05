"""All pairs of vectors above a cosine, over a whole table: inverted lists with bounds that lose no pair.

Angles are a metric. Every vector belongs to the list of its nearest pivot, and knows its angle to it; a
list knows its radius. Two vectors at most theta apart lie in one list, or the one of the lower list is at
most theta plus that list's radius away from the other list's pivot: only such lists are visited. Inside
a list, members are sorted by their angle to the pivot, and a visitor meets those whose angle differs
from its own by at most theta. What is left is compared exactly. At a cosine of 0.95 a list or two are
visited, near 0 most of them: the threshold sets the work, never the result. Where lists spare few visits (a
vector would see more than a quarter of them), lists are made anew, as few as tasks and PART need: a vector
is then sent to each 16,384 others once, not to each list.

Equal vectors are one class, compared once: pairs() are of classes' least ids, members() says who is in
which, so copies cost nothing. A task holds a part of a list and streams the visitors by. Pivots are a
bounded sample; only they and the lists' radii reach the driver.

Vectors that are null, zero, not finite, or not of the usual length are in no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.graph import cut

#: Lists there are at most, members of a list that one task holds, and visitors that meet them at once.
LISTS, PART, BATCH = 1024, 16_384, 256
#: Slack of an angle, for rounding.
SLACK = 1e-6


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


class MetricIndex:
    def __init__(self, vectors: DataFrame, lists: int | None = None) -> None:
        """vectors: id, v."""
        x = F.transform("v", lambda c: c.cast("double"))
        good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e150)) & F.exists("x", lambda c: F.abs(c) > 1e-150)
        rows = vectors.filter("v IS NOT NULL").select("id", x.alias("x")).filter(good)
        self.rows = cut(rows.withColumn("h", F.xxhash64("x")))
        usual = self.rows.agg(F.mode(F.size("x")).alias("n")).first().n
        same = self.rows.filter(F.size("x") == F.lit(usual or 0))
        self.classes = cut(same.groupBy("h", "x").agg(F.min("id").alias("id")))
        self.count = self.classes.count()
        self.adaptive = lists is None
        self.lists = max(1, min(LISTS, math.isqrt(self.count) // 2 if lists is None else lists, self.count or 1))
        sample = self.classes.orderBy("h", "id").limit(self.lists).select("x").toArrow()  # LISTS vectors at most
        self.pivots = _matrix(sample["x"]) if self.count else np.zeros((0, 0))
        self.pivots = self.pivots / np.linalg.norm(self.pivots, axis=1, keepdims=True) if self.count else self.pivots
        self.assigned = cut(self._assign())

    def _assign(self) -> DataFrame:
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    u = _matrix(b.column("x"))
                    u /= np.linalg.norm(u, axis=1, keepdims=True)
                    near = u @ pivots.T
                    best = near.argmax(1)
                    unit = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * u.shape[1], pa.int32()), pa.array(u.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("id"), unit, pa.array(best.astype(np.int32)), pa.array(_angle(near.max(1)))], names=["id", "u", "list", "angle"])

        return self.classes.select("id", "x").mapInArrow(run, "id long, u array<double>, list int, angle double")

    def _seen(self, theta: float) -> float:
        """The share of lists that a vector has to visit, of the pivots as a sample of vectors."""
        radius = np.full(self.lists, -np.inf)
        for r in self.assigned.groupBy("list").agg(F.max("angle").alias("radius")).collect():  # LISTS rows at most
            radius[r.list] = r.radius
        return float((_angle(self.pivots @ self.pivots.T) <= radius[None, :] + theta).mean())

    def members(self) -> DataFrame:
        """id, least: every vector that can be in a pair, and the least id of those equal to it."""
        return self.rows.join(self.classes.withColumnRenamed("id", "least"), ["h", "x"]).select("id", "least")

    def pairs(self, threshold: float) -> DataFrame:
        """a, b, score: least ids a < b of classes of at least this cosine."""
        theta = float(math.acos(min(1.0, max(-1.0, threshold)))) + SLACK
        few = max(2 * self.rows.sparkSession.sparkContext.defaultParallelism, -(-self.count // PART))
        if self.adaptive and self.lists > few and self._seen(theta) > 0.25:
            self.lists, self.pivots = few, self.pivots[:few]
            self.assigned = cut(self._assign())
        held = self.assigned.groupBy("list").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # LISTS rows at most
        radius, parts = np.full(self.lists, -np.inf), np.zeros(self.lists, np.int64)
        for r in held:
            radius[r.list], parts[r.list] = r.radius, -(-r.n // PART)
        pivots = self.pivots

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each vector as a visitor (side 1) of every part of the lists it must see: its own and higher ones."""
            for b in batches:
                if not b.num_rows:
                    continue
                angle = _angle(_matrix(b.column("u")) @ pivots.T)
                own = b.column("list").to_numpy()
                sees = (angle <= radius[None, :] + theta) & (np.arange(len(radius))[None, :] > own[:, None])
                sees[np.arange(len(own)), own] = True
                i, which = np.nonzero(sees)
                n = parts[which]
                i, which, at = np.repeat(i, n), np.repeat(which, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                for k in range(0, len(i), 1 << 14):
                    rows = pa.array(i[k : k + (1 << 14)])
                    w = which[k : k + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("u").take(rows), pa.array(w.astype(np.int32)), pa.array(at[k : k + (1 << 14)].astype(np.int32)), pa.array(angle[i[k : k + (1 << 14)], w]), pa.array(np.ones(len(w), np.int32)), b.column("list").take(rows)], names=["id", "u", "list", "part", "angle", "side", "own"])

        schema = "id long, u array<double>, list int, part int, angle double, side int, own int"
        visitors = self.assigned.mapInArrow(visit, schema)
        n_parts = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
        part = F.pmod(F.xxhash64("id"), n_parts).cast("int").alias("part")
        mine = self.assigned.select("id", "u", "list", part, "angle", F.lit(0).alias("side"), F.col("list").alias("own"))
        both = mine.unionByName(visitors).repartition("list", "part").sortWithinPartitions("list", "part", "side", "angle", "id")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run, held, part = None, [], None
            for whole in batches:
                if not whole.num_rows:
                    continue
                place = np.stack([whole.column(c).to_numpy() for c in ("list", "part", "side")])
                edges = np.concatenate([[0], np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1, [whole.num_rows]])
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    b = whole.slice(s, e - s)
                    if run is None or (place[:2, s] != run).any():
                        run, held, part = place[:2, s], [], None
                    if not place[2, s]:
                        held.append(b)
                        continue
                    if part is None:
                        t = pa.Table.from_batches(held) if held else b.schema.empty_table()
                        part = t["id"].to_numpy(), _matrix(t["u"]) if held else np.zeros((0, 0)), t["angle"].to_numpy()
                        held = []
                    ids, u, angles = part
                    for k in range(0, b.num_rows, BATCH):
                        c = b.slice(k, BATCH)
                        a = c.column("angle").to_numpy()  # ascending
                        lo, hi = np.searchsorted(angles, [a[0] - theta, a[-1] + theta])
                        if lo >= hi:
                            continue
                        score = _matrix(c.column("u")) @ u[lo:hi].T
                        mine = c.column("id").to_numpy()
                        near = score >= threshold
                        same = c.column("own").to_numpy() == run[0]
                        near &= ~same[:, None] | (mine[:, None] < ids[None, lo:hi])
                        i, j = np.nonzero(near)
                        x, y = mine[i], ids[lo + j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score[i, j])], names=["a", "b", "score"])

        return both.mapInArrow(compare, "a long, b long, score double")
