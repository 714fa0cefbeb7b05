"""Many literal rules at once: one pass over each text.

What a literal rule takes as equal (runs of dashes, apostrophes, white space) is made equal in texts and
rules alike, by the same column expression; a rule then is a plain string, and all rules that occur in
a text are found in one scan of it, however many rules there are. Rules of at most GROUP_BYTES are an
Aho-Corasick automaton. More stay a table: a scan with a bitmap of their hashes picks the places of a
text that may hold one, and a join by what stands there finds the rules. Only the first rule in its scope
wins, as in a chain of tests; so of what a text may hold, a few with the least bounds go to the join, and
more only of texts whose first rule is not settled by these.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import APOSTROPHES, DASHES, normal_for_rules
from newsloom.operators.graph import counted_cut, cut

#: Characters of the rules of an automaton.
GROUP_BYTES = 1 << 20
_DASH = "[" + re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", DASHES) + "]"


def canonical(text: Column) -> Column:
    """Normal text with every run of dashes, and the white space around it, one dash, and all apostrophes alike."""
    alike = F.translate(text, DASHES + APOSTROPHES, "-" * len(DASHES) + "'" * len(APOSTROPHES))
    return F.regexp_replace(alike, r"\s*+-[\s-]*+", "-")


def keyed(rules: DataFrame, literal: str) -> DataFrame:
    """Literal rules with `plain`, what they ask for, and `key`, its canonical form; null where a rule of dashes alone is taken as it is."""
    rows = rules.filter(F.trim("rule").startswith(literal)).withColumn("plain", normal_for_rules(F.regexp_replace(F.trim("rule"), "^" + re.escape(literal), "")))
    return rows.withColumn("key", F.when(~F.col("plain").rlike(rf"^(?:\s|{_DASH})*$"), canonical(F.col("plain")))).filter("plain <> ''")


def grouped(rows: Iterator, most: int = GROUP_BYTES) -> Iterator[list[tuple[str, bool, str, tuple, tuple]]]:
    """(pattern, whether canonical, rule, categories, sources) of rules in order, at most `most` characters at a time."""
    group, size = [], 0
    for r in rows:
        pattern = r.plain if r.key is None else r.key
        if group and size + len(pattern) > most:
            yield group
            group, size = [], 0
        group.append((pattern, r.key is not None, r.rule, tuple(r.categories), tuple(r.source_ids)))
        size += len(pattern)
    if group:
        yield group


class Phrases:
    """The rules of a group: one automaton over canonical texts, one over plain ones for rules of dashes alone."""

    def __init__(self, group: list[tuple[str, bool, str, tuple, tuple]]) -> None:
        self.rules = [g[2] for g in group]
        self.scopes = [(frozenset(g[3]), frozenset(g[4])) for g in group]
        self.canonical, self.plain = (self._automaton([(k, g[0]) for k, g in enumerate(group) if g[1] == kind]) for kind in (True, False))

    @staticmethod
    def _automaton(patterns: list[tuple[int, str]]) -> ahocorasick.Automaton | None:
        if not patterns:
            return None
        same: dict[str, list[int]] = {}
        for k, p in patterns:
            same.setdefault(p, []).append(k)
        out = ahocorasick.Automaton()
        for p, who in same.items():
            out.add_word(p, tuple(who))
        out.make_automaton()
        return out

    def first(self, canonical: str, plain: str, category: str, source: int | None) -> str | None:
        """The first rule, in order, that occurs in its scope."""
        best = len(self.rules)
        tried: set[tuple] = set()
        found = itertools.chain(self.canonical.iter(canonical) if self.canonical else (), self.plain.iter(plain) if self.plain else ())
        for _, who in found:
            if who[0] >= best or who in tried:
                continue
            tried.add(who)
            for k in who:
                if k >= best:
                    break
                categories, sources = self.scopes[k]
                if (not categories or category in categories) and (not sources or source in sources):
                    best = k
                    break
        return self.rules[best] if best < len(self.rules) else None


#: Groups that a worker keeps built.
KEPT = 4
_BUILT: dict[str, Phrases] = {}


def _search(shared: Broadcast, token: str) -> Callable[..., Column]:
    """The first rule of a group that hits, as a function of columns."""

    def find(canonical: pa.Array, plain: pa.Array, category: pa.Array, source: pa.Array) -> pa.Array:
        if token not in _BUILT:
            while len(_BUILT) >= KEPT:
                del _BUILT[next(iter(_BUILT))]
            _BUILT[token] = Phrases(shared.value)
        tool = _BUILT[token]
        columns = [a.to_pylist() for a in (canonical, plain, category, source)]
        return pa.array([tool.first(*row) for row in zip(*columns, strict=True)], pa.string())

    return F.arrow_udf(find, "string")


#: Bits of the filter for each pattern, and the most bits it has: 32 MB. Beyond that it lets more through, which the join drops.
FILTER_BITS, FILTER_MOST = 64, 1 << 28
#: The most slots of the table of bounds: 32 MB. With more patterns more share one, and its bounds are less close.
SLOTS_MOST, BLOCK = 1 << 23, 1 << 12
#: Bounds of a text that are looked up first; each further round has so many times more.
BOUNDS = 8
_NONE = (1 << 32) - 1
#: Bytes of texts that are looked at together.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
#: Below this length patterns are looked for at every place; longer ones only where their beginnings of this length, twice it, and so on may stand.
_LEAST = 8


def _levels(most: int) -> list[int]:
    out = [_LEAST]
    while out[-1] * 2 <= most:
        out.append(out[-1] * 2)
    return out


class Windows:
    """Hashes of all windows of some bytes, of any length: differences of one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if n > len(self._up):
            powers = [np.full(n, step, dtype=np.uint64) for step in (_BASE, pow(_BASE, -1, 1 << 64))]
            for p in powers:
                p[0] = 1
            type(self)._up, type(self)._down = (np.multiply.accumulate(p) for p in powers)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=self.sums[1:])

    _up = _down = np.ones(0, dtype=np.uint64)

    def at(self, places: np.ndarray | slice, length: int, salt: int) -> np.ndarray:
        """Hashes of the windows that begin at places. A slice begins at 0."""
        ends = slice(length, places.stop + length) if isinstance(places, slice) else places + length
        h = (self.sums[ends] - self.sums[places]) * self._down[places]
        h ^= h >> np.uint64(29)
        h += np.uint64((2 * length + salt) * _BASE % (1 << 64))
        h *= np.uint64(_MIX)
        return h ^ (h >> np.uint64(32))


#: Salts: a whole pattern, or its beginning.
_WHOLE, _BEGINNING = 0, 1


def _bits_of(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bits of patterns in the filter: of each whole one, and of its beginnings."""
    shift = np.uint64(64 - bits.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                w, start = Windows(np.frombuffer(p, np.uint8)), np.zeros(1, np.int64)
                found.append(w.at(start, len(p), _WHOLE))
                if len(p) >= _LEAST:
                    found += [w.at(start, q, _BEGINNING) for q in _levels(len(p))]
            h = np.concatenate(found) if found else np.zeros(0, np.uint64)
            both = np.concatenate([h >> shift, h & np.uint64(bits - 1)])  # two bits of each
            yield pa.RecordBatch.from_arrays([pa.array(both.astype(np.int64))], ["bit"])

    return run


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(20)) & np.uint64(slots - 1)


def _slots_of(slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of (pattern, bound): the bound and the pattern's slot, as a block and a place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.zeros(1, np.int64)
        for batch in batches:
            found = [Windows(np.frombuffer(p, np.uint8)).at(start, len(p), _WHOLE) for p in batch.column(0).to_pylist()]
            at = _slot(np.concatenate(found), slots).astype(np.int64) if found else start[:0]
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), pa.array(at % BLOCK), batch.column(1)], ["block", "place", "bound"])

    return run


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """The least bounds of a block's slots."""
    out = np.full(BLOCK, _NONE, np.uint32)
    np.minimum.at(out, rows["place"].to_numpy(), rows["bound"].to_numpy().astype(np.uint32))
    return pa.table({"block": [key[0].as_py()], "bounds": pa.array([out.tobytes()], pa.binary())})


def _pieces(data: np.ndarray, starts: np.ndarray, lengths: list[int], bitmap: np.ndarray, shift: np.uint64) -> Iterator[tuple[int, np.ndarray, Windows]]:
    """(length, places, their windows) of what may be a pattern in some texts' bytes. starts: those of the texts, and the end."""
    w, n = Windows(data), len(data)

    def there(bit: np.ndarray) -> np.ndarray:
        return np.flatnonzero((bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)

    def passed(places: np.ndarray | slice, length: int, salt: int) -> np.ndarray:
        h = w.at(places, length, salt)
        first = there(h >> shift)
        return first[there(h[first] & np.uint64(len(bitmap) * 8 - 1))]

    def inside(places: np.ndarray, length: int) -> np.ndarray:
        return places[starts[np.searchsorted(starts, places, "right")] - places >= length]

    def everywhere(length: int, salt: int) -> np.ndarray:
        return inside(passed(slice(0, n - length + 1), length, salt), length) if n >= length else np.zeros(0, np.int64)

    for length in lengths:
        if length < _LEAST:
            yield length, everywhere(length, _WHOLE), w
    if not lengths or lengths[-1] < _LEAST:
        return
    held = everywhere(_LEAST, _BEGINNING)
    for q in _levels(lengths[-1]):
        if q > _LEAST:
            held = inside(held, q)
            held = held[passed(held, q, _BEGINNING)]
        for length in lengths:
            if q <= length < 2 * q:
                places = inside(held, length)
                yield length, places[passed(places, length, _WHOLE)], w


def _found(shared: Broadcast, lengths: list[int], bits: int, bounds: Broadcast | None = None, most: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches of (owner, text): (owner, pattern, next) of what may be a pattern in each text.

    With bounds, batches are (owner, text, least, last), and of what lies between the two only the `most` least
    bounds of a text and piece are there, with all patterns that have them. Where that may not be all, `next` is the
    largest of these bounds, at its patterns.
    """
    shift = np.uint64(64 - bits.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        table = np.frombuffer(bounds.value, np.uint32) if bounds else np.zeros(1, np.uint32)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            least, last = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)) if bounds else (None, None)
            at, end = int(offsets[0]), int(offsets[-1])
            while at < end:
                stop = min(end, at + PIECE + lengths[-1] - 1)  # windows that begin in this piece are whole in it
                first, after = np.searchsorted(offsets, [at, stop], "right")
                starts = np.append(offsets[first:after], stop) - at if after == first or offsets[after - 1] < stop else offsets[first:after] - at
                held = [np.zeros((4, 0), np.int64)]
                for length, places, w in _pieces(data[at:stop], starts, lengths, bitmap, shift):
                    low = table[_slot(w.at(places, length, _WHOLE), len(table))].astype(np.int64) if len(places) else places
                    held.append(np.stack([np.searchsorted(offsets, places + at, "right") - 1, low, places, np.full(len(places), length)]))
                found = np.concatenate(held, axis=1)
                cut_off = np.zeros(found.shape[1], bool)
                if bounds:
                    found, cut_off = _least(found[:, (found[1] < _NONE) & (found[1] >= least[found[0]]) & (found[1] <= last[found[0]])], most)
                seen = {(r, data[at + p : at + p + n].tobytes(), low if more else None) for (r, low, p, n), more in zip(found.T.tolist(), cut_off.tolist(), strict=True)}
                if seen:
                    owners, patterns, after = zip(*seen, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(patterns, pa.binary()), pa.array(after, pa.int64())], ["owner", "pattern", "next"])
                at += PIECE

    return run


def _least(found: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (row, bound, ...) that have one of the `most` least bounds of their row, and whether theirs is the last of so many."""
    found = found[:, np.lexsort((found[1], found[0]))]
    if not found.size:
        return found, np.zeros(0, bool)
    row = np.append(True, found[0, 1:] != found[0, :-1])
    steps = np.cumsum(row | np.append(True, found[1, 1:] != found[1, :-1]))
    rank = steps - steps[np.maximum.accumulate(np.where(row, np.arange(len(row)), 0))]  # of a bound in its row
    return found[:, rank < most], rank[rank < most] == most - 1


def _filter(patterns: DataFrame, count: int) -> tuple[Broadcast, int]:
    """A bitmap of the patterns, and its bits."""
    bits = 1 << min(FILTER_MOST, max(1 << 15, count * FILTER_BITS)).bit_length() - 1
    made = patterns.mapInArrow(_bits_of(bits), "bit long").withColumn("bit", F.col("bit") + 1)
    blocks = made.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    out = bytearray(bits // 8)
    for r in blocks.toLocalIterator():
        out[(r.block - 1) * 4096 : r.block * 4096] = r.map
    return patterns.sparkSession.sparkContext.broadcast(bytes(out)), bits  # at most FILTER_MOST bits


def _bounds(patterns: DataFrame, count: int) -> Broadcast:
    """The least bound of the patterns of each slot. patterns: pattern, bound."""
    slots = 1 << min(SLOTS_MOST, max(BLOCK, count * 2)).bit_length() - 1
    made = patterns.mapInArrow(_slots_of(slots), "block long, place long, bound long")
    out = bytearray(b"\xff" * 4 * slots)
    for r in made.groupBy("block").applyInArrow(_block, "block long, bounds binary").toLocalIterator():
        out[r.block * 4 * BLOCK : (r.block + 1) * 4 * BLOCK] = r.bounds
    return patterns.sparkSession.sparkContext.broadcast(bytes(out))  # at most SLOTS_MOST slots


def _joined_hits(items: DataFrame, rules: DataFrame) -> DataFrame:
    """first_hits() of any number of rules. items: with _plain and _canonical; rules: keyed()."""
    kind = F.col("key").isNotNull().alias("kind")
    scope = [F.array_sort("categories").alias("categories"), F.array_sort("source_ids").alias("source_ids")]
    # of rules that ask for the same in the same scope only the first can be anybody's
    least = rules.select(F.coalesce("key", "plain").cast("binary").alias("pattern"), kind, *scope, F.struct("word_id", "rule").alias("first"))
    least = cut(least.groupBy("pattern", "kind", "categories", "source_ids").agg(F.min("first").alias("first")))
    span = least.agg(F.min("first.word_id").alias("low"), F.max("first.word_id").alias("high")).first()
    low = span.low or 0
    wide = max(0, ((span.high or 0) - low).bit_length() - 31)

    def bound(number: Column) -> Column:
        """A number of 31 bits or so that never falls where a rule's own grows."""
        return F.coalesce(F.shiftright(number.cast("bigint"), wide) - (low >> wide), F.lit(0).cast("bigint"))

    tools = []
    for canonical, column in ((True, "_canonical"), (False, "_plain")):
        patterns = least.filter(F.col("kind") == canonical).groupBy("pattern").agg(F.min(bound(F.col("first.word_id"))).alias("bound"))
        lengths = {r.n: r["count"] for r in patterns.groupBy(F.octet_length("pattern").alias("n")).count().collect()}
        if lengths:
            count = sum(lengths.values())
            tools.append((canonical, column, sorted(lengths), *_filter(patterns.select("pattern"), count), _bounds(patterns, count)))
    if not tools:
        return items.withColumn("hit", F.lit(None).cast("string"))
    # joins move this key, not the texts it is made of
    owner = F.struct(F.unhex(F.sha2("raw_text", 256)).alias("text"), F.coalesce("category", F.lit("other")).alias("category"), F.col("source_id").alias("source"))
    items = items.withColumn("_owner", owner)
    same = [F.col("_owner.text") == F.col("owner.text"), F.col("_owner.category") == F.col("owner.category"), F.col("_owner.source").eqNullSafe(F.col("owner.source"))]
    category, source = F.col("owner.category"), F.col("owner.source")
    inside = ((F.size("categories") == 0) | F.array_contains("categories", category)) & ((F.size("source_ids") == 0) | F.coalesce(F.array_contains("source_ids", source), F.lit(False)))
    todo = items.withColumn("_from", F.lit(0).cast("bigint")).withColumn("_to", F.lit(_NONE - 1).cast("bigint"))
    most, rounds = BOUNDS, []
    while True:
        found = []
        for canonical, column, lengths, shared, bits, bounds in tools:
            texts = todo.select(F.col("_owner").alias("owner"), F.coalesce(column, F.lit("")), "_from", "_to")
            kinds = "owner struct<text:binary,category:string,source:bigint>, pattern binary, next long"
            found.append(texts.mapInArrow(_found(shared, lengths, bits, bounds, most), kinds).withColumn("kind", F.lit(canonical)))
        told = reduce(DataFrame.unionByName, found).join(least, ["pattern", "kind"], "left").withColumn("first", F.when(inside, F.col("first")))
        told = told.filter("first IS NOT NULL OR next IS NOT NULL").groupBy("owner").agg(F.min("first").alias("first"), F.min("next").alias("next"))
        # what was not looked up is beyond `next`, so it comes after a rule whose bound isn't
        unsettled = F.col("next").isNotNull() & (F.col("first").isNull() | (bound(F.col("first.word_id")) > F.col("next")))
        told, open_ = counted_cut(told.withColumn("unsettled", unsettled), F.col("unsettled"))
        rounds.append(told.filter("first IS NOT NULL").select("owner", "first"))
        if not open_:
            break
        most *= BOUNDS
        last = F.when(F.col("first").isNull(), F.lit(_NONE - 1)).otherwise(bound(F.col("first.word_id")))
        again = told.filter("unsettled").select("owner", (F.col("next") + 1).alias("_from"), last.cast("bigint").alias("_to"))
        todo = items.join(again, same).drop("owner")
    hits = rounds[0] if len(rounds) == 1 else cut(reduce(DataFrame.unionByName, rounds).groupBy("owner").agg(F.min("first").alias("first")))
    return items.join(hits.select("owner", F.col("first.rule").alias("hit")), same, "left").drop("owner", "_owner")


def first_hits(items: DataFrame, rules: DataFrame, literal: str, most: int = GROUP_BYTES) -> DataFrame:
    """items plus `hit`, the first literal rule by word_id that occurs in its scope. rules: scoped().

    Up to `most` characters of rules are one automaton of each worker. More are never held by anybody:
    a bitmap of bounded size tells which places of a text may hold one, and what stands there is joined
    with the rules.
    """
    rows = items.withColumn("_plain", normal_for_rules(F.col("raw_text"))).withColumn("_canonical", canonical(F.col("_plain")))
    wanted = keyed(rules, literal)
    size = wanted.agg(F.sum(F.length(F.coalesce("key", "plain"))).alias("n")).first().n or 0
    if size > most:
        return _joined_hits(rows, wanted).drop("_plain", "_canonical")
    hit = F.lit(None).cast("string")
    for group in grouped(wanted.orderBy("word_id").toLocalIterator(), most):  # one, of at most `most` characters
        search = _search(items.sparkSession.sparkContext.broadcast(group), uuid.uuid4().hex)
        plain = F.lit("") if all(g[1] for g in group) else F.col("_plain")
        hit = search(F.col("_canonical"), plain, F.coalesce("category", F.lit("other")), F.col("source_id"))
    return rows.withColumn("hit", hit).drop("_plain", "_canonical")
