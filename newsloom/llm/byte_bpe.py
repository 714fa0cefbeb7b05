"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation finds the matches of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regular expression. Code points become classes by one table lookup; a class and what
follows it locally (an apostrophe with its contraction, white space before non-space) give a symbol;
each symbol is a transition function over the few states of a transducer. Functions compose
associatively, and the symbols generate a small monoid, so an inclusive scan over monoid elements
(blocks in lockstep, then across blocks) yields the state before every character of a whole batch.
State and symbol tell whether a match starts there. Slices between boundaries feed a cache of merged
pieces; ids are decoded through the vocabulary with the byte offset of each token at hand. A text of
more than PIECE characters is scanned piece by piece, the state carried on.

Defined results: a null text is the empty text, which has no tokens; invalid UTF-8 becomes U+FFFD;
ids, doc_ids and order of equal rows are independent of each other; other columns are not read.
What a text takes besides itself is bounded, but for one match of very many characters, which takes
about 60 bytes a byte while it is merged. `tokens` encodes equal texts (by MD5) once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Places, binary_values, documents, file_based, materialise, row_key, slices, small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a worker's cache before it starts anew, and of the longest piece that it takes.
CACHE_BYTES = 64 << 20
CACHED_PIECE = 64
#: Characters of a long text that are scanned at once.
PIECE = 1 << 20

#: Character classes. GAP stands before each text of a batch.
LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER, GAP = range(7)
#: Transducer states: what the previous character left open.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, TAKE_1, TAKE_2 = range(8)
N_STATES = 8


@cache
def class_table() -> np.ndarray:
    """Class of every code point: U+0020 is BLANK, other white space SPACE."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    spaces = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = SPACE
    table[0x20] = BLANK
    table[ord("'")] = APOSTROPHE
    return table


# A symbol is (class, lookahead). Lookahead of an apostrophe: letters of the contraction it could
# begin (0, 1, 2). Of white space: 1 if a non-space follows, so that a run ends before it.
SYMBOLS = [(LETTER, 0), (NUMBER, 0), (BLANK, 0), (BLANK, 1), (SPACE, 0), (SPACE, 1), (APOSTROPHE, 0), (APOSTROPHE, 1), (APOSTROPHE, 2), (OTHER, 0), (GAP, 0)]
_SYMBOL = {s: i for i, s in enumerate(SYMBOLS)}


def step(state: int, symbol: tuple[int, int]) -> tuple[int, bool]:
    """(next state, whether a match starts at this character)."""
    kind, ahead = symbol
    if kind == GAP:
        return FRESH, False
    if state == TAKE_2:
        return TAKE_1, False
    if state == TAKE_1:
        return FRESH, False
    if kind in (BLANK, SPACE):
        # a run of white space leaves its last character to what follows; only U+0020 joins a word
        starts = state != IN_SPACE or ahead == 1
        if ahead == 1:
            return (AFTER_BLANK if kind == BLANK else FRESH), starts
        return IN_SPACE, starts
    joins = state == AFTER_BLANK
    if kind == LETTER:
        return IN_LETTERS, not (joins or state == IN_LETTERS)
    if kind == NUMBER:
        return IN_NUMBERS, not (joins or state == IN_NUMBERS)
    if joins or state == IN_OTHER:
        return IN_OTHER, False
    if kind == APOSTROPHE and ahead:
        return (TAKE_1 if ahead == 1 else TAKE_2), True
    return IN_OTHER, True


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(element of each symbol, flat composition table, elements[state, element], starts[state, symbol], size)."""
    functions = [tuple(step(s, x)[0] for s in range(N_STATES)) for x in SYMBOLS]
    elements = {tuple(range(N_STATES)): 0}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in functions:
            h = tuple(g[f[s]] for s in range(N_STATES))
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    n = len(elements)
    order = list(elements)
    table = np.array([[elements[tuple(g[f[s]] for s in range(N_STATES))] for g in order] for f in order], np.uint16)
    starts = np.array([[step(s, x)[1] for x in SYMBOLS] for s in range(N_STATES)])
    return np.array([elements[f] for f in functions], np.uint16), table.ravel(), np.array(order, np.uint8).T.copy(), starts, n


def scan(elements: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive scan of the composition, first then second, over monoid elements."""
    _, table, _, _, n = monoid()
    m = -(-len(elements) // block)
    if m <= 1:
        out = np.empty(len(elements), np.uint16)
        now = 0
        for i, e in enumerate(elements.tolist()):
            now = out[i] = int(table[now * n + e])
        return out
    grid = np.zeros(m * block, np.uint16)  # 0 is the identity
    grid[: len(elements)] = elements
    grid = np.ascontiguousarray(grid.reshape(m, block).T)
    wide = np.int32(n)
    for j in range(1, block):
        np.take(table, grid[j - 1].astype(np.int32) * wide + grid[j], out=grid[j])
    before = np.zeros(m, np.uint16)
    before[1:] = scan(np.ascontiguousarray(grid[-1, :-1]), block)
    grid = table[before.astype(np.int32)[None, :] * wide + grid]
    return grid.T.ravel()[: len(elements)]


def boundaries(points: np.ndarray, gap: np.ndarray, state: int = FRESH) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which a match starts, state after each position). gap: mask of positions between texts; state: before the first."""
    kinds = class_table()[points]
    kinds[gap] = GAP
    n = len(points)
    symbols = np.array([_SYMBOL[k, 0] for k in range(7)], np.uint8)[kinds]
    following = np.empty_like(kinds)
    following[:-1] = kinds[1:]
    following[-1] = GAP
    blank = (kinds == BLANK) | (kinds == SPACE)
    ends = blank & (following != BLANK) & (following != SPACE) & (following != GAP)
    symbols[ends] += 1
    at = np.flatnonzero(kinds == APOSTROPHE)
    if len(at):
        padded = np.concatenate([points[: n], np.zeros(2, points.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        gaps = np.concatenate([gap, np.ones(2, bool)])
        symbols[at] += (one & ~gaps[at + 1]) + 2 * (two & ~gaps[at + 1] & ~gaps[at + 2]).astype(np.uint8)
    of_symbol, _, states, starts, _ = monoid()
    after = states[state][scan(of_symbol[symbols])]
    before = np.empty_like(after)
    before[0] = state
    before[1:] = after[:-1]
    return np.flatnonzero(starts[before, symbols]), after


class Codec:
    """Ranks of a tiktoken file, with a bounded cache of merged pieces."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = {i: b for b, i in self.ranks.items()}
        self.names = {i: str(i) for i in self.vocabulary}
        self.widths = np.zeros(max(self.vocabulary) + 1, np.int64)
        for i, b in self.vocabulary.items():
            self.widths[i] = len(b)
        self.small = np.dtype(np.uint16 if len(self.widths) <= 1 << 16 else np.uint32)
        self.cache: dict[bytes, list[int]] = {}
        self.cached = 0

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Repeatedly join the adjacent pair of lowest rank, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 256:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over linked parts, for pieces without white space of any length."""
        ranks, n = self.ranks, len(piece)
        right, left, end, alive = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", range(1, n + 1)), bytearray(b"\1" * n)
        # rank, start and end in one number
        heap = [r << 80 | i << 40 | i + 2 for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        low = (1 << 40) - 1
        while heap:
            top = heapq.heappop(heap)
            i, stop = top >> 40 & low, top & low
            j = right[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i], right[i] = stop, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (x := ranks.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, x << 80 | i << 40 | end[right[i]])
            if left[i] >= 0 and (x := ranks.get(piece[left[i] : stop])) is not None:
                heapq.heappush(heap, x << 80 | left[i] << 40 | stop)
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        """The matches of the pattern in each text, as bytes."""
        points = np.frombuffer(("\0" + "\0".join(texts)).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(np.concatenate([[1], sizes + 1]))  # of each text; the last is past the end
        gap = np.zeros(len(points), bool)
        gap[first[:-1] - 1] = True
        cut, _ = boundaries(points, gap)
        widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(widths, out=at[1:])
        joined = ("\0" + "\0".join(texts)).encode()
        out = []
        where = np.searchsorted(cut, first)
        for k in range(len(texts)):
            edges = at[cut[where[k] : where[k + 1]]].tolist()
            edges.append(int(at[first[k + 1] - 1]))
            out.append([joined[a:b] for a, b in itertools.pairwise(edges)])
        return out

    def long_pieces(self, text: str) -> Iterator[list[bytes]]:
        """The matches of one long text, in portions."""
        state, open_ = FRESH, bytearray()  # the match that goes on in the next portion
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE]
            points = np.frombuffer((part + text[at + PIECE : at + PIECE + 2]).encode("utf-32-le"), np.uint32)
            cut, after = boundaries(points, np.zeros(len(points), bool), state)
            cut, state, points = cut[cut < len(part)], int(after[len(part) - 1]), points[: len(part)]
            raw = part.encode()
            place = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), out=place[1:])
            edges = place[cut].tolist()
            if not edges:
                open_ += raw
                continue
            open_ += raw[: edges[0]]
            yield [*([bytes(open_)] if open_ else []), *(raw[a:b] for a, b in itertools.pairwise(edges))]
            open_ = bytearray(raw[edges[-1] :])
        if open_:
            yield [bytes(open_)]

    def _ids(self, pieces: list[bytes]) -> list[int]:
        if self.cached > CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        long: dict[bytes, list[int]] = {}
        for p in set(pieces).difference(self.cache):
            ids = self.merge(p)
            if len(p) > CACHED_PIECE:
                long[p] = ids
                continue
            self.cache[p] = ids
            self.cached += 200 + len(p) + 36 * len(ids)
        if not long:
            return list(itertools.chain.from_iterable(map(self.cache.__getitem__, pieces)))
        return list(itertools.chain.from_iterable(self.cache[p] if len(p) <= CACHED_PIECE else long[p] for p in pieces))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._ids(pieces) for pieces in self.pieces(texts)]

    def portions(self, texts: list[str]) -> Iterator[Iterable[list[int]]]:
        """Of each text its ids, in portions where it is long."""
        short = iter(self.pieces([t for t in texts if len(t) <= PIECE]))
        for t in texts:
            yield ([self._ids(next(short))] if len(t) <= PIECE else map(self._ids, self.long_pieces(t)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """Byte range of each token in the decoded text."""
        ends = list(itertools.accumulate(len(self.vocabulary[i]) for i in ids))
        return list(zip([0, *ends[:-1]], ends, strict=True)) if ids else []


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, with_tokens: bool) -> Iterator[pa.RecordBatch]:
    """Digests of each row, and its ids if asked for, packed as small as they are; columns before the text are kept."""
    tool = codec(path)
    for whole in batches:
        for batch in slices(whole, "body"):
            kept = batch.schema.names[:-1]
            sizes, ids_sha, back_sha, packed = [], [], [], []
            for portions in tool.portions([(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column("body")]):
                size, named, back, all_ids = 0, hashlib.sha256(), hashlib.sha256(), bytearray()
                for ids in portions:
                    named.update(("," * (size > 0) + ",".join(map(tool.names.__getitem__, ids))).encode())
                    back.update(tool.decode(ids))
                    size += len(ids)
                    if with_tokens:
                        all_ids += np.array(ids, tool.small).tobytes()
                sizes.append(size)
                ids_sha.append(named.hexdigest())
                back_sha.append(back.hexdigest())
                packed.append(bytes(all_ids))
            cols = [*(batch.column(k) for k in kept), pa.array(sizes, pa.int64()), pa.array(ids_sha), pa.array(back_sha)]
            names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_tokens:
                cols.append(pa.array(packed, pa.binary()))
                names.append("packed")
            yield pa.RecordBatch.from_arrays(cols, names=names)


def unpack_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The last column, packed ids, as ids and the bytes where they end; other columns are kept."""
    tool = codec(path)
    for whole in batches:
        for batch in slices(whole, "packed"):
            raw, at = binary_values(batch.column("packed"))
            cut = (at - at[0]) // tool.small.itemsize
            flat = np.frombuffer(raw[at[0] : at[-1]].tobytes(), tool.small).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(tool.widths[flat])])
            ends = ends[1:] - np.repeat(ends[cut[:-1]], np.diff(cut))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (flat, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*batch.schema.names[:-1], "ids", "ends"])


def _body() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")


def digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. The file of ranks must be at the same path on every node."""
    path = public_tokenizers.path(ranks)
    small_batches(docs.sparkSession)
    return docs.select("doc_id", _body()).mapInArrow(lambda it: encode_batches(it, path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The tokens themselves: doc_id, shard and place (file and row it was read from), digests, ids, and the byte where each id ends.

    Rows of one text share one encoding, which is joined to each of them.
    """
    path = public_tokenizers.path(ranks)
    docs = file_based(docs)
    small_batches(docs.sparkSession)
    digest = F.unhex(F.md5(_body())).alias("digest")
    where = docs.metadataColumn("_metadata")
    rows = materialise(docs.select("doc_id", where["file_name"].alias("shard"), where["row_index"].alias("place"), *row_key(docs), digest), "digests")
    first = rows.groupBy("digest").agg(F.min(F.struct("_file", "_row")).alias("first")).select("first.*")
    schema = "digest binary, n_tokens long, ids_sha256 string, decoded_sha256 string, packed binary"
    coded = Places(docs, first).gather([digest, _body()], lambda found: found.select("digest", "body").mapInArrow(lambda it: encode_batches(it, path, True), schema), "tokens")
    every = rows.select("doc_id", "shard", "place", "digest").join(coded, "digest").drop("digest")
    return every.mapInArrow(lambda it: unpack_batches(it, path), "doc_id long, shard string, place long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, ends array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES = {"op3_byte_bpe": query}
