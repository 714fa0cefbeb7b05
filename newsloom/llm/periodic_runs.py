"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text are in one class of level l if the l words from there are equal. Level l + 1 is
made from level l by looking at the predecessors of small classes only: of the parts a class fell
into, the largest is left out, so a position is touched O(log n) times (`Partition`). Classes are
segments of one array and their members are linked in order of position. Neighbours of a class of
level l at distance l are a square whose root is no power; squares of one period at consecutive
positions are one run. Distances that a level will ask for are looked up once for each doubling of the
level, and kept up to date from the positions that are touched. Texts are refined many at a time, each
ended by a word of its own.

A run is a stretch with smallest period q (in words), at least max(LEAST, 2 q) words long, that can't
be extended. Words are equal if their bytes are: equal hashes are compared byte by byte.

Defined results: a null or empty text, or one without words, has no words and no runs (four nulls, the
hash of the empty string twice); a null doc_id is never made periodic; of repeated rows each has its
result; what a text takes besides its own bytes is about 90 bytes a word. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import SEGMENT, Words, binary_values, documents, mix64, slices, small_batches

LEAST = 12
#: Texts that are refined together take about this many bytes.
TOGETHER = 2 << 20
#: Touched positions up to which a level is refined one by one.
FEW = 6
#: Words that are joined for a digest at once.
JOINED = 1 << 16


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] numbers, then those of the next."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - size), size)


class Partition:
    """Classes of positions by equal factors; a class is named by the slot its segment begins at."""

    def __init__(self, symbols: np.ndarray, last: np.ndarray) -> None:
        """symbols: of each position; equal ones are equal words. last: of each position, the longest period its text can have."""
        n = len(symbols)
        self.last = last
        self.members = np.argsort(symbols, kind="stable").astype(np.int32)
        told = symbols[self.members]
        edge = np.flatnonzero(np.concatenate([[True], told[1:] != told[:-1], [True]]))
        sizes = np.diff(edge)
        self.slot = np.empty(n, np.int32)
        self.slot[self.members] = np.arange(n, dtype=np.int32)
        self.of = np.empty(n, np.int32)
        self.of[self.members] = np.repeat(edge[:-1], sizes)
        self.size = np.ones(n, np.int32)
        self.size[edge[:-1]] = sizes
        self.next, self.before = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        joined = np.ones(max(n - 1, 0), bool)
        joined[edge[1:-1] - 1] = False
        a, b = self.members[:-1][joined], self.members[1:][joined]
        self.next[a], self.before[b] = b, a
        self.touched = np.zeros(n, bool)

    def start(self) -> np.ndarray:
        """Positions whose successors' classes split theirs at level 1: all that aren't alone."""
        return np.flatnonzero((self.size[self.of] > 1) & (self.last >= 2))

    def predecessors(self, begin: np.ndarray, size: np.ndarray, level: int) -> np.ndarray:
        """Positions before the members of these classes, in texts that still can have a square."""
        i = self.members[_ranges(begin, size)] - 1
        i = i[i >= 0]
        return i[(self.size[self.of[i]] > 1) & (self.last[i] > level)]

    def split(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Split the classes of positions i by the classes of their successors. (small classes: begin, size; positions with another neighbour)."""
        own, by = self.of[i], self.of[i + 1]
        order = np.lexsort((i, by, own))
        i, own, by = i[order], own[order], by[order]
        new_class = np.concatenate([[True], own[1:] != own[:-1]])
        new_part = new_class | np.concatenate([[True], by[1:] != by[:-1]])
        begins = np.flatnonzero(new_class)
        count = np.diff(np.append(begins, len(i)))
        parts = np.add.reduceat(new_part.astype(np.int64), begins)
        rest = self.size[own[begins]] - count
        splits = parts + (rest > 0) > 1
        if not splits.all():
            kept = np.repeat(splits, count)
            if not kept.any():
                none = np.zeros(0, np.int64)
                return none, none, none
            i, own, new_class, new_part = i[kept], own[kept], new_class[kept], new_part[kept]
            begins = np.flatnonzero(new_class)
            count, parts, rest = count[splits], parts[splits], rest[splits]
        self._unlink(i, own)
        changed = self._before_gone
        part_at = np.flatnonzero(new_part)
        part_size = np.diff(np.append(part_at, len(i)))
        inner = ~np.append(new_part[1:], True)
        self.next[i] = np.where(inner, np.append(i[1:], -1), -1)
        self.before[i] = np.where(np.append(False, inner[:-1]), np.append(-1, i[:-1]), -1)

        names = own[begins].astype(np.int64)
        slots = _ranges(names + rest, count)
        there = self.members[slots]
        self.touched[i] = True
        stays = there[~self.touched[there]]
        self.touched[i] = False
        now = self.slot[i]
        holes = now[now < np.repeat(names + rest, count)]
        self.members[holes], self.slot[stays] = stays, holes
        self.members[slots], self.slot[i] = i, slots
        begin = slots[part_at]
        self.size[names[rest > 0]] = rest[rest > 0]
        self.size[begin] = part_size
        self.of[i] = np.repeat(begin, part_size)

        first = np.cumsum(parts) - parts
        largest = np.maximum.reduceat(part_size, first)
        rest_small = rest < largest
        small = np.ones(len(begin), bool)
        at_largest = np.flatnonzero(part_size == np.repeat(largest, parts))
        of_class = np.repeat(np.arange(len(parts)), parts)[at_largest]
        one = np.concatenate([[True], of_class[1:] != of_class[:-1]])
        small[at_largest[one][rest_small[of_class[one]]]] = False
        left = rest_small & (rest > 0)
        return np.concatenate([begin[small], names[left]]), np.concatenate([part_size[small], rest[left]]), np.concatenate([changed, i])

    def _unlink(self, i: np.ndarray, own: np.ndarray) -> None:
        """Take positions out of the lists of their classes."""
        order = np.lexsort((i, own))
        i, own = i[order], own[order]
        chained = (own[1:] == own[:-1]) & (self.next[i[:-1]] == i[1:])
        head, tail = i[np.append(True, ~chained)], i[np.append(~chained, True)]
        p, q = self.before[head], self.next[tail]
        self.next[p[p >= 0]] = q[p >= 0]
        self.before[q[q >= 0]] = p[q >= 0]
        self._before_gone = p[p >= 0]

    def split_few(self, positions: list[int]) -> tuple[list[int], list[int], list[int]]:
        """split() of a handful of positions, one by one; classes and positions as lists."""
        groups: dict[int, dict[int, list[int]]] = {}
        of, size, members, slot, following, before = self.of, self.size, self.members, self.slot, self.next, self.before
        for i in sorted(positions):
            groups.setdefault(int(of[i]), {}).setdefault(int(of[i + 1]), []).append(i)
        begins, sizes, changed = [], [], []
        for name, parts in groups.items():
            count = sum(map(len, parts.values()))
            rest = int(size[name]) - count
            if len(parts) + (rest > 0) < 2:
                continue
            end = name + rest + count
            for part in parts.values():
                for i in part:
                    p, q = int(before[i]), int(following[i])
                    if p >= 0:
                        following[p] = q
                        changed.append(p)
                    if q >= 0:
                        before[q] = p
            found = []
            for part in reversed(parts.values()):
                last = -1
                for i in reversed(part):
                    end -= 1
                    other, at = int(members[end]), int(slot[i])
                    members[at], slot[other], members[end], slot[i] = other, at, i, end
                    following[i] = last
                    if last >= 0:
                        before[last] = i
                    last = i
                before[last] = -1
                for i in part:
                    of[i] = end
                found.append((end, len(part)))
                changed += part
            if rest:
                size[name] = rest
            for begin, n in found:
                size[begin] = n
            if rest:
                found.append((name, rest))
            largest = max(range(len(found)), key=lambda k: found[k][1])
            for k, (begin, n) in enumerate(found):
                if k != largest:
                    begins.append(begin)
                    sizes.append(n)
        return begins, sizes, changed


def squares(symbols: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(period, sorted positions) of all squares whose root is no power. last: as of Partition; 0 where a text ends."""
    if not len(symbols):
        return
    classes = Partition(symbols, last)
    most = int(last.max())
    touched: np.ndarray | list[int] = classes.start()
    level, until = 1, 1
    base = edges = np.zeros(0, np.int64)
    fresh: dict[int, list] = {}
    while level <= most:
        if level == until:  # the distances of the next levels, up to twice this one
            until *= 2
            at = np.flatnonzero((classes.next >= 0) & (last >= level))
            distance = classes.next[at] - at
            at, distance = at[(distance >= level) & (distance < until)], distance[(distance >= level) & (distance < until)]
            order = np.argsort(distance, kind="stable")
            base, distance, fresh = at[order], distance[order], {}
            edges = np.searchsorted(distance, np.arange(level, until + 1))
            begin = level
        a, z = edges[level - begin], edges[level - begin + 1]
        late = fresh.pop(level, None)
        if z > a or late:
            here = np.unique(np.concatenate([base[a:z], *(late or [])]))
            here = here[(classes.next[here] - here == level) & (last[here] >= level)]  # classes of texts that are through stay as they were
            if len(here):
                yield level, here
        if not len(touched):
            break
        level += 1
        if len(touched) <= FEW:
            begins, sizes, changed = classes.split_few([int(i) for i in touched])
            touched = []
            for b, n in zip(begins, sizes, strict=True):
                for j in classes.members[b : b + n].tolist():
                    if j and classes.last[j - 1] > level and classes.size[classes.of[j - 1]] > 1:
                        touched.append(j - 1)
            for i in changed:
                d = int(classes.next[i]) - i
                if level <= d < until:
                    fresh.setdefault(d, []).append(np.array([i]))
            continue
        begins, sizes, changed = classes.split(np.asarray(touched))
        if len(changed):
            d = classes.next[changed].astype(np.int64) - changed
            soon = (d >= level) & (d < until)
            changed, d = changed[soon], d[soon]
            if len(changed):
                order = np.argsort(d, kind="stable")
                changed, d = changed[order], d[order]
                cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]]))
                for s, e in zip(cut[:-1], cut[1:], strict=True):
                    fresh.setdefault(int(d[s]), []).append(changed[s:e])
        touched = classes.predecessors(begins, sizes, level)


def runs_of(symbols: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period), by text, start and period, of texts that lie one after the other. first: where each begins, and the end."""
    texts = len(first) - 1
    n = np.diff(first)
    place = first[:-1] + np.arange(texts)  # each text is followed by an end of its own
    all_ = np.full(int(first[-1]) + texts, -1, np.int64)
    owner = np.repeat(np.arange(texts), n)
    all_[np.arange(int(first[-1])) + owner] = symbols
    ends = place + n
    all_[ends] = -1 - np.arange(texts)
    last = np.zeros(len(all_), np.int32)
    last[np.arange(int(first[-1])) + owner] = np.repeat(n // 2, n)
    found = [np.zeros((0, 3), np.int64)]
    for period, at in squares(all_, last):
        cut = np.flatnonzero(at[1:] != at[:-1] + 1) + 1
        begin, end = at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)]
        length = end - begin + 2 * period
        long = length >= least
        if long.any():
            found.append(np.column_stack([begin[long], length[long], np.full(int(long.sum()), period)]))
    rows = np.concatenate(found)
    text = np.searchsorted(place, rows[:, 0], side="right") - 1
    rows = np.column_stack([text, rows[:, 0] - place[text], rows[:, 1:]]) if len(rows) else np.zeros((0, 4), np.int64)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _same_bytes(body: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether the ranges at a and b are equal, pair by pair."""
    upto = np.cumsum(size)
    k = 0
    while k < len(size):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + SEGMENT, side="right")))
        for lo in range(0, int(size[k]) if end == k + 1 else 1, SEGMENT):  # a very long word by itself
            part = np.minimum(size[k:end] - lo, SEGMENT) if end == k + 1 else size[k:end]
            if (body[_ranges(a[k:end] + lo, part)] != body[_ranges(b[k:end] + lo, part)]).any():
                return False
        k = end
    return True


def symbols_of(words: Words, owner: np.ndarray) -> np.ndarray:
    """Numbers of words: the same for equal words of one text, different otherwise."""
    key = mix64(words.hash + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = order[same], order[same + 1]
    size = words.end - words.start
    if (owner[a] == owner[b]).all() and (size[a] == size[b]).all() and _same_bytes(words.body, words.start[a], words.start[b], size[a]):
        out = np.empty(len(key), np.int64)
        new = np.ones(len(key), np.int64)
        new[same + 1] = 0
        out[order] = np.cumsum(new)
        return out
    known: dict[tuple[int, bytes], int] = {}  # hashes collide
    return np.array([known.setdefault((o, words.body[s:e].tobytes()), len(known)) for o, s, e in zip(owner.tolist(), words.start.tolist(), words.end.tolist(), strict=True)], np.int64)


def repeated(doc_id: int | None, n: int) -> np.ndarray:
    """Which word stands at each place: every tenth document's end, by the hash of its number, repeats a stretch of it."""
    at = np.arange(n)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


COLUMNS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapsed(rows: np.ndarray, n: int) -> np.ndarray:
    """Places that stay when all but the first period of each run goes. rows: start, length, period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def _joined_sha256(body: bytes, start: np.ndarray, end: np.ndarray) -> str:
    out = hashlib.sha256()
    for k in range(0, len(start), JOINED):
        if k:
            out.update(b" ")
        out.update(b" ".join([body[s:e] for s, e in zip(start[k : k + JOINED].tolist(), end[k : k + JOINED].tolist(), strict=True)]))
    return out.hexdigest()


def _described(ids: list[int | None], column: pa.Array) -> list[tuple]:
    words = Words(*binary_values(column))
    first = words.first
    at = np.concatenate([np.zeros(0, np.int64), *[first[k] + repeated(i, int(first[k + 1] - first[k])) for k, i in enumerate(ids)]])
    owner = np.repeat(np.arange(len(ids)), np.diff(first))
    rows = runs_of(symbols_of(words, owner)[at], first)
    edge = np.searchsorted(rows[:, 0], np.arange(len(ids) + 1))
    body = words.body.tobytes()
    out = []
    for k, i in enumerate(ids):
        mine = rows[edge[k] : edge[k + 1], 1:]
        told = hashlib.sha256("".join([f"{s},{n},{p}\n" for s, n, p in mine.tolist()]).encode()).hexdigest()
        here = at[first[k] : first[k + 1]][collapsed(mine, int(first[k + 1] - first[k]))]
        best = (None,) * 4
        if len(mine):
            s, n, p = mine[np.lexsort((mine[:, 2], mine[:, 0], -mine[:, 1]))[0]].tolist()
            best = (s, n, p, 1000 * n // p)
        out.append((i, len(mine), *best, told, _joined_sha256(body, words.start[here], words.end[here])))
    return out


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "body", TOGETHER):
            rows = _described(batch.column("doc_id").to_pylist(), batch.column("body"))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), COLUMNS, strict=True)], names=[c for c, _ in COLUMNS])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Of each row of docs: doc_id, number of runs, the longest one, digests of all runs and of the text without repetitions."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).mapInArrow(run_batches, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir))


QUERIES = {"op13_periodic_runs": query}
