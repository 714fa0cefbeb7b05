"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. One scan turns each text into its set of word shingles (64-bit hashes, 54 bits kept), a digest of
   the set, band hashes of its minima and a packed signature of the LOW_BITS low bits of each.
2. Equal sets are one class with one representative; from here on only classes count, so thousands
   of copies cost one row each.
3. Representatives meet in band buckets (BANDS bands of ROWS minima: a pair of similarity 0.8 meets
   but for (1 - 0.8^ROWS)^BANDS). In a bucket, similarities are estimated by bit counts on the packed
   signatures, corrected for chance collisions. Each member proposes its most similar partner, and
   the most connected member it may be linked to (the original among edited copies); of all its
   proposals the best of either kind is confirmed on the full sets.
4. Later rounds look only at buckets that still hold several components, with longer signatures
   (FINE minima) of their members. In the first of them, of each component but a bucket's largest FEW
   members propose their best PROPOSALS partners of other components: enough to join what belongs
   together but for rare cases. In the last round all members outside the largest component propose all
   partners that are left; there, sets of at most SMALL shingles are compared exactly on the spot, so
   that families just below the threshold emit nothing. Pairs refuted before are not tested again.
   After the last round every candidate pair is inside a component, refuted on full sets or by their
   sizes, or estimated below MARGIN standard errors under the threshold, and components only grow:
   nothing is left to look for.
5. Confirmed links make components by large-star and small-star steps.

Buckets of more than CHUNK members are dealt to several tasks. In the first round each part is on its
own (what should meet across parts does so in other bands or later); in later rounds members outside
the largest component meet all members, part against part. A bucket of one component, however large,
is never compared again.

Defined results: null or blank texts have the empty set (n_shingles 0) and link with nothing, even
among each other; a text of fewer words than a shingle has one shingle, its whole sequence; null
doc_ids come last when the smallest is chosen; of equal rows all have the same component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Places, Scratch, Words, binary_values, documents, file_based, materialise, mix64, row_key, slices, small_batches, whole_runs, without
from newsloom.llm.components import components

BANDS, ROWS = 30, 5
PERMUTATIONS = BANDS * ROWS
FINE = 1024
LOW_BITS = 4
MARGIN = 4.5
TILE = 1024
#: Members of a bucket that one task compares.
CHUNK = 2048
#: Members of a large bucket that others are compared with in the first round, and its hubs.
SAMPLE, HUBS = 256, 16
#: Proposals of a member in the round before the last, and members of a component in a bucket that make them.
PROPOSALS, ALL = 16, 1 << 30
FEW = 32
#: Sets of at most SMALL shingles travel whole in the last round: of two of them the similarity is exact, by
#: products of their incidence with COLUMNS shingles at a time.
SMALL, COLUMNS = 256, 8192
#: Shingles that are hashed at once.
STEP = 1 << 18
#: Bits of a shingle's hash; the rest of a word holds its text's place in a slice.
HASH_BITS = 54

_RNG = np.random.default_rng(20240917)
_A = (_RNG.integers(0, 1 << 32, FINE, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, FINE, np.uint64).astype(np.uint32)
CHANCE = 2.0**-LOW_BITS


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in turn, sorted; where each text's begin, and the end)."""
    words = Words(*binary_values(column), lower=True)
    n, sizes = len(column), np.diff(words.first)
    count = np.maximum(sizes - width + 1, np.minimum(sizes, 1))
    ends = np.cumsum(count)
    packed = np.empty(int(ends[-1]) if n else 0, np.uint64)
    for lo in range(0, len(packed), STEP):
        number = np.arange(lo, min(lo + STEP, len(packed)))
        mine = np.searchsorted(ends, number, side="right")
        place = words.first[mine] + number - (ends - count)[mine]
        last = words.first[mine + 1]
        key = np.zeros(len(number), np.uint64)
        for k in range(width):
            value = np.where(place + k < last, words.hash[np.minimum(place + k, len(words.hash) - 1)], np.uint64(0x5851F42D4C957F2D))
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + value)
        packed[lo : lo + STEP] = (mine.astype(np.uint64) << np.uint64(HASH_BITS)) | (key >> np.uint64(64 - HASH_BITS))
    packed.sort()
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    packed = packed[new]
    edges = np.searchsorted(packed, np.arange(n + 1, dtype=np.uint64) << np.uint64(HASH_BITS))
    packed &= np.uint64((1 << HASH_BITS) - 1)
    return packed, edges


def minima(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """[permutation, set]: least values of non-empty sets."""
    small = (mix64(values + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((count, len(starts)), np.uint32)
    work = np.empty_like(small)
    for k in range(count):
        np.multiply(small, _A[k], out=work)
        work += _B[k]
        np.minimum.reduceat(work, starts, out=out[k])
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """[set, byte]: the low bits of each minimum, padded to whole words."""
    nibbles = (least.T & np.uint32(15)).astype(np.uint8)
    out = np.zeros((len(nibbles), 8 * math.ceil(len(least) * LOW_BITS / 64)), np.uint8)
    out[:, : len(least) // 2] = nibbles[:, 0::2] | (nibbles[:, 1::2] << 4)
    return out


def sketch(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two digests, band hashes, packed signatures) of non-empty sets."""
    starts = edges[:-1]
    mixed = mix64(values + np.uint64(1))
    digests = np.stack([np.add.reduceat(mixed, starts), np.add.reduceat(mix64(mixed ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)], 1)
    least = minima(values, starts, PERMUTATIONS)
    bands = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(starts), b + 1, np.uint64)
        for r in range(ROWS):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + least[b * ROWS + r])
        bands[:, b] = acc
    return digests, bands, packed(least)


def similarity(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures (last axis: words) of `count` minima, corrected for chance."""
    differ = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int32)
    for w in range(a.shape[-1]):
        x = a[..., w] ^ b[..., w]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        differ += np.bitwise_count(x & np.uint64(0x1111111111111111))
    return (1 - differ / count - CHANCE) / (1 - CHANCE)


def floor_estimate(threshold: float, count: int) -> float:
    """MARGIN standard errors under the threshold of pairs without chance collisions: low bits of two shingles collide always or never, in small sets often never."""
    return (threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / count) - CHANCE) / (1 - CHANCE)


def _list_array(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))


SKETCH = "doc_id long, _file long, _row long, n long, d1 long, d2 long, bands array<long>, signature binary"


def _sketch_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "body"):
            values, edges = shingle_sets(batch.column("body"), width)
            n = np.diff(edges)
            full = np.flatnonzero(n)
            digests, bands, low = np.zeros((len(n), 2), np.uint64), np.zeros((0, BANDS), np.uint64), np.zeros((0, 8), np.uint8)
            if len(full):
                digests[full], bands, low = sketch(values, np.append(edges[full], edges[-1]))
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
            place = np.cumsum(n > 0) - 1
            blobs = [low[place[i]].tobytes() if n[i] else None for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_file"), batch.column("_row"), pa.array(n, pa.int64()),
                 pa.array(np.ascontiguousarray(digests[:, 0]).view(np.int64)),
                 pa.array(np.ascontiguousarray(digests[:, 1]).view(np.int64)), _list_array(bands.ravel().view(np.int64), ends), pa.array(blobs, pa.binary())],
                names=["doc_id", "_file", "_row", "n", "d1", "d2", "bands", "signature"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Full sets and fine signatures."""
    for whole in batches:
        for batch in slices(whole, "body"):
            values, edges = shingle_sets(batch.column("body"), width)
            blobs = [values[edges[i] : edges[i + 1]].tobytes() for i in range(batch.num_rows)]
            full = np.flatnonzero(np.diff(edges))
            fine = iter(packed(minima(values, edges[full], FINE)) if len(full) else ())
            some = np.diff(edges) > 0
            signatures = [next(fine).tobytes() if s else None for s in some]
            yield pa.RecordBatch.from_arrays([batch.column("_file"), batch.column("_row"), pa.array(blobs, pa.binary()), pa.array(signatures, pa.binary())], names=["_file", "_row", "items", "fine"])


def _confirm_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Whether 100 * intersection >= percent * union, from the full sorted sets."""
    for b in batches:
        linked = []
        for x, y in zip(b.column("xa"), b.column("xb"), strict=True):
            u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            if len(u) > len(v):
                u, v = v, u
            at = np.searchsorted(v, u)
            both = int((v[np.minimum(at, len(v) - 1)] == u).sum()) if len(v) else 0
            linked.append(100 * both >= percent * (len(u) + len(v) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def propose(nodes: np.ndarray, comps: np.ndarray, sigs: np.ndarray, refuted: list, role: np.ndarray, least: float, count: int, threshold: float, top: int = 1, every: bool = False, sizes: np.ndarray | None = None, small: Incidence | None = None) -> tuple[np.ndarray, ...]:
    """(member, partner, estimate, degree of the partner), by place: proposals between components of one bucket.

    Members whose role has bit 1 propose to those whose role has bit 2. every: their `top` best
    partners of all; otherwise the best of a sample and of the hubs, and the best hub. sizes of the sets
    rule out partners that are too large or too small for the threshold.
    """
    none = np.zeros(0, np.int64)
    rows, columns = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if every and top < ALL:
        rows = _few_of_each(comps[rows], rows, FEW)
    if not len(rows) or not len(columns) or (comps == comps[0]).all():
        return none, none, np.zeros(0), none
    degree = np.zeros(len(nodes), np.int64)
    if not every:
        sample = columns if len(columns) <= SAMPLE else np.sort(columns[np.argsort(mix64(nodes[columns].view(np.uint64)), kind="stable")[:SAMPLE]])
        for i in range(0, len(nodes), TILE):
            degree[i : i + TILE] = (similarity(sigs[i : i + TILE, None, :], sigs[None, sample, :], count) >= threshold).sum(1)
        hubs = columns[np.argsort(-degree[columns], kind="stable")[:HUBS]]
        columns = np.union1d(sample, hubs)
        is_hub = np.isin(columns, hubs)
    place = {int(x): i for i, x in enumerate(nodes[columns])} if any(refuted[r] for r in rows) else {}
    out: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(rows), TILE // 4):
        mine = rows[i : i + TILE // 4]
        est = np.empty((len(mine), len(columns)))
        for j in range(0, len(columns), TILE):
            cols = columns[j : j + TILE]
            part = similarity(sigs[mine, None, :], sigs[None, cols, :], count)
            part[comps[mine][:, None] == comps[cols][None, :]] = -1
            if sizes is not None:
                part[apart(sizes[mine][:, None], sizes[cols][None, :], threshold)] = -1
            if small is not None:
                small.rule_out(part, mine, cols, threshold)
            est[:, j : j + TILE] = part
        for k, r in enumerate(mine):
            for other in refuted[r] or ():
                if (p := place.get(other, -1)) >= 0:
                    est[k, p] = -1
        if top >= est.shape[1]:
            r, c = np.nonzero(est >= least)
        else:
            c = np.argpartition(-est, top - 1, axis=1)[:, :top].ravel()
            r = np.repeat(np.arange(len(mine)), top)
            keep = est[r, c] >= least
            r, c = r[keep], c[keep]
        found = [np.stack([r, c])]
        if not every:
            rank = np.where((est >= least) & is_hub[None, :], degree[columns][None, :], -1)
            c = rank.argmax(1)
            r = np.flatnonzero(rank[np.arange(len(mine)), c] >= 0)
            found.append(np.stack([r, c[r]]))
        r, c = np.concatenate(found, 1)
        out.append((mine[r], columns[c], est[r, c], degree[columns[c]]))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def _few_of_each(comps: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The first `most` rows of each component."""
    order = np.argsort(comps, kind="stable")
    ordered = comps[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return np.sort(rows[order[place < most]])


def apart(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sizes can't be as similar as the threshold, whatever they hold."""
    return np.minimum(a, b) < threshold * np.maximum(a, b) - 1e-6


class Incidence:
    """Which small sets of a bucket hold which of the shingles that several of them hold."""

    def __init__(self, sets: list[bytes | None], sizes: np.ndarray) -> None:
        self.small = np.array([s is not None for s in sets])
        self.sizes = sizes
        parts = [np.frombuffer(s or b"", np.uint64) for s in sets]
        owner = np.repeat(np.arange(len(sets)), [len(p) for p in parts])
        _, code, times = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        shared = times[code] > 1
        _, code = np.unique(code[shared], return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.code, self.owner = code[order], owner[shared][order]

    def common(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """[row, column]: shingles in both sets."""
        total = np.zeros((len(rows), len(cols)), np.float32)
        place = np.full((2, len(self.sizes)), -1)
        place[0, rows], place[1, cols] = np.arange(len(rows)), np.arange(len(cols))
        for lo in range(0, int(self.code[-1]) + 1 if len(self.code) else 0, COLUMNS):
            a, z = np.searchsorted(self.code, [lo, lo + COLUMNS])
            sides = []
            for k, n in enumerate((len(rows), len(cols))):
                at = place[k][self.owner[a:z]]
                side = np.zeros((n, COLUMNS), np.float32)
                side[at[at >= 0], self.code[a:z][at >= 0] - lo] = 1
                sides.append(side)
            total += sides[0] @ sides[1].T
        return total

    def rule_out(self, part: np.ndarray, rows: np.ndarray, cols: np.ndarray, threshold: float) -> None:
        """-1 for the pairs of small sets that don't reach the threshold, by a safe hair below it."""
        if not (self.small[rows].any() and self.small[cols].any()):
            return
        both = self.common(rows, cols)
        union = self.sizes[rows][:, None] + self.sizes[cols][None, :] - both
        known = self.small[rows][:, None] & self.small[cols][None, :]
        part[known & (both < threshold * union - 1e-3)] = -1


def _first_meeting(buckets: np.ndarray, bands: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j (of one bucket) are in no earlier bucket together."""
    first = (bands[i] == bands[j]).argmax(1)
    return bands[i, first] == buckets[i]


def _proposal_batches(batches: Iterator[pa.RecordBatch], least: float, count: int, threshold: float, top: int, every: bool) -> Iterator[pa.RecordBatch]:
    for table, cuts in whole_runs(batches, "run"):
        nodes, comps, sizes, role = (table[c].to_numpy() for c in ("node", "component", "n", "role"))
        sigs = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint64).reshape(len(nodes), -1)
        refuted, whole = table["refuted"].to_pylist(), table["small"].to_pylist()
        two = cuts[:-1][np.diff(cuts) == 2]  # most buckets: a pair
        est = similarity(sigs[two], sigs[two + 1], count)
        good = (est >= least) & (comps[two] != comps[two + 1]) & ~apart(sizes[two], sizes[two + 1], threshold)
        good[good] = [nodes[i + 1] not in (refuted[i] or ()) for i in two[good]]
        found = [(two[good], two[good] + 1, est[good], np.ones(int(good.sum()), np.int64))]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 2:
                small = Incidence(whole[s:e], sizes[s:e]) if top == ALL else None
                i, j, est, degree = propose(nodes[s:e], comps[s:e], sigs[s:e], refuted[s:e], role[s:e], least, count, threshold, top, every, sizes[s:e], small)
                found.append((i + s, j + s, est, degree))
        i, j, est, degree = (np.concatenate([p[k] for p in found]) for k in range(4))
        if every and len(i):
            bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(nodes), BANDS)
            keep = _first_meeting(table["bucket"].to_numpy(), bands, i, j)
            i, j, est, degree = i[keep], j[keep], est[keep], degree[keep]
        _, once = np.unique(np.stack([nodes[i], nodes[j]], 1), axis=0, return_index=True)  # of the buckets in hand
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i[once]]), pa.array(nodes[j[once]]), pa.array(est[once]), pa.array(degree[once])], names=["a", "b", "est", "degree"])


ROWS_OF_A_RUN = ["run", "role", "bucket", "node", "component", "n", "signature", "refuted", "bands", "small"]


class NearDuplicates:
    """links = NearDuplicates(docs, width, percent); links.members: a row of each input row."""

    def __init__(self, docs: DataFrame, width: int = 5, percent: int = 80) -> None:
        self.width, self.percent = width, percent
        small_batches(docs.sparkSession)
        self.docs = file_based(docs)
        scan = self.docs.select("doc_id", *row_key(self.docs), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
        self.sketches = materialise(scan.mapInArrow(lambda it: _sketch_batches(it, width), SKETCH), "sketches")
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row")
        classes = self.sketches.filter("n > 0").groupBy("d1", "d2").agg(F.min(rank).alias("best"))
        self.classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        with Scratch(docs.sparkSession) as scratch:
            self.labels = scratch.keep(self._link(), "labels")

    def _link(self) -> DataFrame:
        """node, component: of all nodes that have a link."""
        own = self.classes.select("node", F.col("best._file").alias("_file"), F.col("best._row").alias("_row"))
        reps = self.sketches.select("_file", "_row", "n", "bands", "signature").join(own, ["_file", "_row"])
        rows = materialise(reps.select("node", "_file", "_row", "n", "signature", "bands"), "reps")
        spread = rows.select("node", F.explode("bands").alias("bucket"))
        shared = materialise(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
        self.buckets = materialise(spread.join(shared, "bucket"), "buckets")
        met = materialise(rows.join(self.buckets.select("node").distinct(), "node", "left_semi"), "met")
        self.sets = self._sets(met)

        part = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("size") / CHUNK))
        run = F.when(F.col("size") <= CHUNK, F.col("bucket")).otherwise(F.xxhash64("bucket", part))
        nothing = F.lit(None).cast("array<long>")
        first = self.buckets.withColumn("component", F.col("node")).withColumn("run", run).withColumn("role", F.lit(3)).withColumn("refuted", nothing)
        first = first.join(met.select("node", "n", "signature"), "node").withColumn("bands", nothing).withColumn("small", F.lit(None).cast("binary"))
        proposed = self._proposals(first, PERMUTATIONS, 1, False)
        best = proposed.groupBy("a").agg(F.max(F.struct("est", "b")).alias("near"), F.max(F.struct("degree", "est", "b")).alias("hub"))
        first = materialise(best.select("a", F.explode(F.array("near.b", "hub.b")).alias("b")).distinct(), "first")
        tested = self._confirm(first)
        refuted = tested.filter("not linked").select("a", "b")
        labels = components(tested.filter("linked"))
        # a member's own proposals, two at most, don't take the place of better ones again
        asked = first.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("a").alias("node"), F.col("b").alias("partner"))
        own_no = asked.join(refuted.toDF("x", "y"), ["x", "y"]).groupBy("node").agg(F.collect_set("partner").alias("refuted"))
        for top, no in ((PROPOSALS, own_no), (ALL, None)):
            proposed = self._open(labels, no, top).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("refuted"))
            known = proposed.union(refuted.select("a", "b", F.lit(True))).groupBy("a", "b").agg(F.bool_or("refuted").alias("refuted"))
            fresh = materialise(known.filter("NOT refuted").select("a", "b"), "proposals")
            if fresh.isEmpty():
                continue
            tested = self._confirm(fresh)
            refuted = refuted.union(tested.filter("not linked").select("a", "b"))
            found = tested.filter("linked").select("a", "b")
            if not found.isEmpty():
                labels = components(found.union(labels.select("node", "component")))
        return labels

    def _sets(self, met: DataFrame) -> DataFrame:
        """node, n, items, fine, bands: the full set, long signature and buckets of each node that shares one."""
        width = self.width
        own = met.select("node", "_file", "_row", "n", "bands")

        def work(rows: DataFrame) -> DataFrame:
            found = rows.select("_file", "_row", "body").mapInArrow(lambda it: _set_batches(it, width), "_file long, _row long, items binary, fine binary")
            return found.join(own, ["_file", "_row"]).select("node", "n", "items", "fine", "bands")

        return Places(self.docs, own).gather([F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")], work, "sets")

    @staticmethod
    def _unordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _confirm(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked."""
        percent, sets = self.percent, self.sets
        both = self._unordered(pairs).join(sets.select(F.col("node").alias("a"), F.col("items").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("xb")), "b")
        return materialise(both.select("a", "b", "xa", "xb").mapInArrow(lambda it: _confirm_batches(it, percent), "a long, b long, linked boolean"), "tested")

    def _proposals(self, rows: DataFrame, count: int, top: int, every: bool) -> DataFrame:
        threshold = self.percent / 100
        least = floor_estimate(threshold, count)
        rows = rows.select(*ROWS_OF_A_RUN).repartition("run").sortWithinPartitions("run")
        return rows.mapInArrow(lambda it: _proposal_batches(it, least, count, threshold, top, every), "a long, b long, est double, degree long")

    def _open(self, labels: DataFrame, no: DataFrame | None, top: int) -> DataFrame:
        """Candidate pairs between components, from buckets that hold several. no: node, its refuted partners."""
        at = self.buckets.select("bucket", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sizes = at.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
        open_ = sizes.agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top")).filter("comps > 1")
        open_ = open_.select("bucket", F.col("top.component").alias("largest"), F.ceil(F.col("size") / CHUNK).alias("parts"), F.ceil((F.col("size") - F.col("top.n")) / CHUNK).alias("row_parts"))
        at = at.join(materialise(open_, "open"), "bucket")
        outside = F.col("component") != F.col("largest")
        # small buckets are one run; of others, parts of the outside meet parts of all
        whole = at.filter("parts = 1").select("bucket", "node", "component", F.col("bucket").alias("run"), F.when(outside, 3).otherwise(2).alias("role"))
        deal = lambda n: F.pmod(F.xxhash64("node", "bucket"), F.col(n))
        large = at.filter("parts > 1")
        proposers = large.filter(outside).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", "node", "component", F.xxhash64("bucket", deal("row_parts"), F.col("j").cast("bigint")).alias("run"), F.lit(1).alias("role"))
        partners = large.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1))).select("bucket", "node", "component", F.xxhash64("bucket", F.col("i").cast("bigint"), deal("parts")).alias("run"), F.lit(2).alias("role"))
        at = whole.union(proposers).union(partners)
        small = F.when(F.lit(top == ALL) & (F.col("n") <= SMALL), F.col("items"))
        rows = at.join(self.sets.select("node", "n", F.col("fine").alias("signature"), "bands", small.alias("small")), "node")
        rows = rows.join(no, "node", "left") if no is not None else rows.withColumn("refuted", F.lit(None).cast("array<long>"))
        return self._proposals(rows, FINE, top, True)

    @property
    def members(self) -> DataFrame:
        """doc_id, n_shingles, component_id, first (this row stands for its component), _file, _row."""
        named = self.classes.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = materialise(named.groupBy("component").agg(F.min("best").alias("head")), "heads")
        groups = materialise(named.join(heads, "component").select("d1", "d2", "head"), "groups")
        out = self.sketches.select("doc_id", "_file", "_row", "n", "d1", "d2").join(groups, ["d1", "d2"], "left")
        single = F.col("n") == 0
        return out.select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(single, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
            (single | ((F.col("head._file") == F.col("_file")) & (F.col("head._row") == F.col("_row")))).alias("first"),
            "_file", "_row",
        )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether the doc_id is the component's)."""
    out = NearDuplicates(docs, width, percent).members
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each group of near-duplicates, all columns."""
    index = NearDuplicates(docs, width, percent)
    gone = index.members.filter(~F.col("first")).select("_file", "_row")
    return without(index.docs, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2, percent=80)


QUERIES = {"op10_minhash": query}
