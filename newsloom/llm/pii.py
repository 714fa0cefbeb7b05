"""Personal data by a semi-Markov conditional random field over candidate segments.

A text is read as atoms: runs of ASCII letters and digits, runs of white space, runs of other letters,
single marks. A candidate segment is a stretch of at most ATOMS atoms with something that tells (a
digit, an at sign, a long run); one with white space has no letters, and one of several atoms has at
most CHARS characters. Features look at the whole segment (digits, checksum, address shapes,
separators, mixture of characters) and at what stands around it. Each kind has a weight for each
feature; a segmentation scores the sum over its segments, atoms outside any score nothing. Decoding
picks the best segmentation, so boundaries and kinds are chosen together; it's exact, and since other
atoms score nothing only segments of positive score take part.

Weights maximise the regularised conditional likelihood, with the partition function from the forward
and backward sums over all segmentations. They are learnt from at most SAMPLE stretches of each kind
(secrets with and without a name before them apart) and of none (those of least hash, copies once), which rules label: the base patterns, and for secrets
SEEDS. Stretches where a base pattern matched what its own check refused aren't learnt from, but for single
numbers with a wrong checksum: these are where the model is to tell better.

Base spans stay as they are, found per kind from left to right; the model adds segments that overlap
none of them. n_email, n_ip, n_card and n_phone count base spans.

Defined results: null and empty texts have no spans (digests of the empty string); offsets are code
points; of repeated rows each has its result; an empty table, or one without a labelled stretch, gives
a model that adds nothing. Texts of any length are read in windows of WINDOW characters with the
context that segments need, so a text takes a bounded multiple of its size. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import documents, slices, small_batches

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
ATOMS, CHARS = 16, 256
#: Characters before a segment that features look at, and characters of a window.
BEFORE = 32
WINDOW = 1 << 18
#: Stretches of each kind, and of none, that the model is learnt from; their atoms and characters.
SAMPLE, SAMPLE_ATOMS, SAMPLE_CHARS = 200, 48, 400
STEPS, RATE, DECAY = 150, 0.3, 0.02
CLIP = 12.0
#: A run of letters and digits this long tells by itself.
LONG = 16

IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: What labels secrets for learning: access keys, and values after their names.
SEEDS = re.compile(r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16})(?![A-Za-z0-9])|(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9]{12,})(?![A-Za-z0-9])")
NAMED = re.compile(r"(?i:password|passwd|pwd|token|secret|key|auth|bearer|credential)s?[\"']?\s{0,3}[=:]\s{0,3}[\"']?\Z")
_TOLD = bytes(48 if c == 64 or 48 <= c <= 57 else 97 if 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def telling(body: bytes) -> bool:
    """Whether a text can have a candidate segment: nearly all that can't are told here."""
    told = body.translate(_TOLD)
    return b"0" in told or b"a" * LONG in told


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c)
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, but each character is looked at a few times only."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at)  # nothing that holds this sign is an address
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((start, kind, end) of the base patterns in order, stretches that matched and failed the check)."""
    out, failed = [(s, 0, e) for s, e in _emails(text)], []
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            if kind == 1:
                good = all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))
            else:
                digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 200 else ""
                good = 14 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), kind, m.end()))
            elif kind != 2 or (m.end() - m.start() > 19 or len(digits) < m.end() - m.start() >= 14):  # digits alone with a wrong checksum are no card
                failed.append(m.span())
    return sorted(out), failed


_WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WIDE_NEWLINES = [0x85, 0x2028, 0x2029]
SPACE, WORD, OTHER, MARK = range(4)
_ASCII = np.full(128, MARK, np.int8)
_ASCII[[9, 10, 11, 12, 13, 32]] = SPACE
_ASCII[[c for c in range(128) if chr(c).isalnum()]] = WORD
NAMES = [
    "bias", "loose_at", "address", "quad", "plus", "digits_10_15", "no_luhn", "luhn", "bare_digits", "joined_digits", "phone_shape", "touched_left", "touched_right",
    "digit_left", "digit_right", "long", "mixed", "upper_mixed", "hex_mixed", "named", "quoted", "one_atom", "many_atoms", "letters", "digits_16", "digits_11", "few_digits", "odd_marks",
]
N_FEATURES = len(NAMES)


class Atoms:
    """Atoms of a text, with running counts of what they hold."""

    def __init__(self, text: str) -> None:
        self.text = text
        c = self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(c < 128, _ASCII[np.minimum(c, 127)], OTHER)
        wide = np.flatnonzero(kind == OTHER)
        kind[wide[np.isin(c[wide], _WIDE_SPACES)]] = SPACE
        newline = (c >= 10) & (c <= 13)
        newline[wide[np.isin(c[wide], _WIDE_NEWLINES)]] = True
        new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == MARK)) if len(c) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(c)).astype(np.int64) if len(c) else self.start
        self.kind = kind[self.start]
        digit = (c >= 48) & (c <= 57)
        upper = (c >= 65) & (c <= 90)
        lower = (c >= 97) & (c <= 122)
        self.digits = self._count(digit)
        self.uppers = self._count(upper)
        self.lowers = self._count(lower)
        self.hexes = self._count(digit | ((c >= 97) & (c <= 102)))
        self.others = self._count(kind == OTHER)
        self.spaces = self._count(kind == SPACE)
        self.lines = self._count(newline)
        self.ats, self.dots, self.pluses = self._count(c == 64), self._count(c == 46), self._count(c == 43)
        self.opens, self.closes, self.hyphens = self._count(c == 40), self._count(c == 41), self._count(c == 45)
        self.marks = self._count(kind == MARK)
        first = c[self.start] if len(c) else c
        size = self.end - self.start
        has_digit = self.digits[1:] > self.digits[:-1]
        self.tells = has_digit | (first == 64) | ((self.kind == WORD) & (size >= LONG))
        self.begins = (self.kind == WORD) | (first == 43) | (first == 40)
        self.ends = self.kind == WORD

    def _count(self, mask: np.ndarray) -> np.ndarray:
        """Of the characters before each atom, and of all."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return total[np.append(self.start, len(mask))] if len(mask) else total

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last atoms of all candidate segments."""
        n = len(self.start)
        at = np.flatnonzero(self.tells)
        if not len(at):
            return at, at
        near = np.zeros(n + ATOMS, np.int32)  # starts with a telling atom among the next ones
        np.add.at(near, np.maximum(at - ATOMS + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        starts = np.flatnonzero((np.cumsum(near)[:n] > 0) & self.begins)
        told = np.append(at, n)
        first = told[np.searchsorted(at, starts)]  # the next telling atom
        i, j = np.repeat(starts, ATOMS), (starts[:, None] + np.arange(ATOMS)).ravel()
        good = (j >= np.repeat(first, ATOMS)) & (j < n)
        i, j = i[good], j[good]
        over = lambda count: count[j + 1] - count[i]
        letters = over(self.uppers) + over(self.lowers) + over(self.others)
        good = self.ends[j] & (over(self.lines) == 0) & ((over(self.spaces) == 0) | (letters == 0)) & ((i == j) | (self.end[j] - self.start[i] <= CHARS))
        return i[good], j[good]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        text, n = self.text, len(self.codes)
        over = lambda count: count[j + 1] - count[i]
        digits, uppers, lowers, spaces = over(self.digits), over(self.uppers), over(self.lowers), over(self.spaces)
        letters = uppers + lowers + over(self.others)
        marks, ats, dots = over(self.marks), over(self.ats), over(self.dots)
        size = (self.end[j] - self.start[i]).astype(np.int64)
        a, z = self.start[i], self.end[j]
        before = np.where(a > 0, self.codes[np.maximum(a - 1, 0)], 32)
        after = np.where(z < n, self.codes[np.minimum(z, n - 1)], 32)
        before2 = np.where(a > 1, self.codes[np.maximum(a - 2, 0)], 32)
        after2 = np.where(z + 1 < n, self.codes[np.minimum(z + 1, n - 1)], 32)
        is_digit = lambda c: (c >= 48) & (c <= 57)
        joins = lambda c: np.isin(c, [64, 46, 45, 95, 37, 43])
        worded = lambda c: is_digit(c) | ((c | 32) >= 97) & ((c | 32) <= 122)
        first = self.codes[a]
        plus = first == 43
        one = i == j
        plain = (letters == 0) & (marks == over(self.hyphens)) & (digits + spaces + marks == size)
        joined = plain & (spaces + marks <= digits)
        phone = plus & (letters == 0) & (over(self.opens) == over(self.closes)) & (over(self.pluses) == 1) & (marks == over(self.pluses) + over(self.opens) + over(self.closes) + over(self.hyphens) + dots)
        x = np.zeros((len(i), N_FEATURES), np.float32)
        columns = {
            "bias": np.ones(len(i), bool), "loose_at": ats > 0, "plus": plus, "digits_10_15": (digits >= 10) & (digits <= 15) & (letters == 0), "no_luhn": (digits >= 14) & (digits <= 19) & (letters == 0),
            "bare_digits": plain & one, "joined_digits": joined, "phone_shape": phone,
            "touched_left": worded(before) | joins(before) & worded(before2), "touched_right": worded(after) | joins(after) & worded(after2),
            "digit_left": (before == 32) & is_digit(before2), "digit_right": (after == 32) & is_digit(after2),
            "long": one & (size >= LONG) & (letters > 0), "mixed": one & (size >= 12) & (digits > 1) & (letters > 1), "upper_mixed": one & (size >= LONG) & (uppers + digits == size) & (digits > 0) & (uppers > 0),
            "hex_mixed": one & (size >= LONG) & (over(self.hexes) == size) & (digits < size), "quoted": np.isin(before, [34, 39]) & np.isin(after, [34, 39]), "one_atom": one, "many_atoms": j - i >= 8,
            "letters": letters > 0, "digits_16": np.zeros(len(i), bool), "digits_11": digits == 11, "few_digits": digits < 7, "odd_marks": marks > ats + dots + over(self.hyphens) + over(self.pluses) + over(self.opens) + over(self.closes),
        }
        for name, column in columns.items():
            x[:, NAMES.index(name)] = column
        k_luhn, k_no_luhn, k_16, k_quad, k_address, k_loose, k_named = (NAMES.index(c) for c in ("luhn", "no_luhn", "digits_16", "quad", "address", "loose_at", "named"))
        for k in np.flatnonzero((digits >= 14) & (digits <= 19) & (letters == 0) & joined):
            x[k, k_luhn] = _luhn(re.sub("[^0-9]", "", text[a[k] : z[k]]))
            x[k, k_no_luhn] = 1 - x[k, k_luhn]
            x[k, k_16] = x[k, k_luhn] * (digits[k] == 16)
        for k in np.flatnonzero((dots == 3) & (marks == 3) & (letters == 0) & (spaces == 0) & (digits <= 12)):
            parts = text[a[k] : z[k]].split(".")
            x[k, k_quad] = all(p and int(p) <= 255 for p in parts)
        for k in np.flatnonzero((ats == 1) & (spaces == 0)):
            at = text.index("@", a[k])
            x[k, k_address] = bool(DOMAIN.fullmatch(text, at + 1, z[k])) and at > a[k]
            x[k, k_loose] = not x[k, k_address]
        for k in np.flatnonzero(one & (size >= 8)):
            x[k, k_named] = bool(NAMED.search(text[max(0, a[k] - BEFORE) : a[k]]))
        return x


def _pieces(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, begin, end): windows, and the characters in which the segments of each may begin. Cuts are between atoms."""
    n, begin = len(text), 0
    word = re.compile(r"[A-Za-z0-9]*")
    while begin < n:
        end = min(begin + WINDOW, n)
        if end < n and word.match(text[end - 1]).end():
            end = word.match(text, end).end()
        yield max(0, begin - BEFORE), min(n, end + CHARS + 2), begin, end
        begin = end


def proposals(text: str, weights: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[float, int, int, int]]:
    """(score, start, end, kind) of the segments of positive score that overlap nothing taken. taken: sorted, disjoint."""
    out = []
    lefts = np.array([s for s, _ in taken], np.int64)
    rights = np.array([e for _, e in taken], np.int64)
    for lo, hi, begin, end in _pieces(text):
        atoms = Atoms(text[lo:hi])
        i, j = atoms.candidates()
        s, e = atoms.start[i] + lo, atoms.end[j] + lo
        free = (s >= begin) & (s < end)
        if len(taken):
            free &= np.searchsorted(rights, s, side="right") == np.searchsorted(lefts, e, side="left")
        i, j, s, e = i[free], j[free], s[free], e[free]
        for k in range(0, len(i), 1 << 16):
            part = slice(k, k + (1 << 16))
            score = atoms.features(i[part], j[part]).astype(np.float64) @ weights.T
            best = score.argmax(1)
            top = score[np.arange(len(best)), best]
            out += [(float(top[x]), int(s[part][x]), int(e[part][x]), int(best[x])) for x in np.flatnonzero(top > 1e-6)]
    return out


def decode(found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the segments of the best segmentation. Equal sums: the one with the earlier end stays."""
    found = sorted(found, key=lambda x: (x[2], x[1], x[3]))
    ends = [x[2] for x in found]
    total, back = [0.0], [0]
    for k, (score, start, _, _) in enumerate(found):
        before = bisect_right(ends, start, 0, k)
        take = total[before] + score
        total.append(max(total[k], take))
        back.append(before if take > total[k] else -1)
    out, k = [], len(found)
    while k:
        if back[k] < 0:
            k -= 1
        else:
            _, start, end, kind = found[k - 1]
            out.append((start, kind, end))
            k = back[k]
    return out[::-1]


def _disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def stretches(text: str) -> Iterator[tuple[str, str]]:
    """(what is in it, stretch) that a model can be learnt from: a line's part around what tells, with its labels unambiguous."""
    base, failed = base_spans(text)
    labels = base + [(m.start(k), 4, m.end(k)) for m in SEEDS.finditer(text) for k in (1, 2) if m[k]]
    for m in re.finditer(r"[^\s@]*[0-9@][^\n]{0,40}|[A-Za-z]{16,}[^\n]{0,40}", text):
        lo, hi = max(m.start() - 60, text.rfind("\n", 0, m.start()) + 1), m.end()
        if hi - lo > SAMPLE_CHARS or any(s < hi and lo < e for s, e in failed):
            continue
        mine = [x for x in labels if x[0] < hi and lo < x[2]]
        if any(s < lo or e > hi for s, _, e in mine):
            continue
        named = {KINDS[k] if k < 4 else f"secret {shape}" for (s, k, e) in mine for shape in (["named"] if NAMED.search(text[max(0, s - BEFORE) : s]) else ["bare"])}
        for kind in named or {"none"}:
            yield kind, text[lo:hi]


class Example:
    """A stretch as atoms with its candidate segments and the labelled ones among them; None where labels fit no segments."""

    @staticmethod
    def of(text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]] | None:
        base, _ = base_spans(text)
        labels = sorted(base + [(m.start(k), 4, m.end(k)) for m in SEEDS.finditer(text) for k in (1, 2) if m[k]])
        if any(a[2] > b[0] for a, b in zip(labels, labels[1:], strict=False)):
            return None
        atoms = Atoms(text)
        i, j = atoms.candidates()
        if len(atoms.start) > SAMPLE_ATOMS or not len(i):
            return None
        place = {(int(s), int(e)): k for k, (s, e) in enumerate(zip(atoms.start[i], atoms.end[j], strict=True))}
        if any((s, e) not in place for s, _, e in labels):
            return None
        return len(atoms.start), i, j, atoms.features(i, j), [(place[s, e], kind) for s, kind, e in labels]


def likelihood(weights: np.ndarray, owner: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, told: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """(log likelihood, its gradient) of labelled stretches. owner, i, j, x: of each candidate; told: [candidate, kind], 1 where labelled."""
    score = np.clip(x @ weights.T, -CLIP, CLIP)
    power = np.exp(score)
    each = power.sum(1)
    order_j, order_i = np.argsort(j, kind="stable"), np.argsort(i, kind="stable")
    cut_j, cut_i = np.searchsorted(j[order_j], np.arange(SAMPLE_ATOMS + 1)), np.searchsorted(i[order_i], np.arange(SAMPLE_ATOMS + 1))
    ahead, back = np.ones((n, SAMPLE_ATOMS + 1)), np.ones((n, SAMPLE_ATOMS + 1))
    for k in range(SAMPLE_ATOMS):
        mine = order_j[cut_j[k] : cut_j[k + 1]]
        ahead[:, k + 1] = ahead[:, k] + np.bincount(owner[mine], each[mine] * ahead[owner[mine], i[mine]], n)
    for k in range(SAMPLE_ATOMS - 1, -1, -1):
        mine = order_i[cut_i[k] : cut_i[k + 1]]
        back[:, k] = back[:, k + 1] + np.bincount(owner[mine], each[mine] * back[owner[mine], j[mine] + 1], n)
    whole = ahead[:, -1]
    chance = (ahead[owner, i] * back[owner, j + 1] / whole[owner])[:, None] * power
    value = float((score * told).sum() - np.log(whole).sum())
    return value, ((told - chance) * (np.abs(score) < CLIP)).T @ x


def learn(texts: list[str]) -> np.ndarray:
    """Weights [kind, feature] by Adam on the penalised likelihood of these stretches."""
    weights = np.zeros((len(KINDS), N_FEATURES))
    examples = [e for e in map(Example.of, texts) if e]
    if not any(e[4] for e in examples):
        return weights
    owner = np.concatenate([np.full(len(e[1]), k) for k, e in enumerate(examples)])
    i, j, x = (np.concatenate([e[k] for e in examples]) for k in (1, 2, 3))
    told = np.zeros((len(i), len(KINDS)))
    start = 0
    for e in examples:
        for k, kind in e[4]:
            told[start + k, kind] = 1
        start += len(e[1])
    x = x.astype(np.float64)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        _, gradient = likelihood(weights, owner, i, j, x, told, len(examples))
        gradient -= DECAY * weights
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rate = RATE * (1 - step / (STEPS + 1))
        weights = weights + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return np.round(weights * 2**20) / 2**20  # sums of these are exact, whatever their order


def _stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "body"):
            rows = [r for b in batch.column("body") if telling(b.as_py()) for r in stretches(b.as_py().decode("utf-8", "replace"))]
            kinds, texts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["kind", "stretch"])


def fit(docs: DataFrame) -> np.ndarray:
    """Weights from SAMPLE stretches of each kind: at most 7 * SAMPLE * SAMPLE_CHARS characters reach the driver."""
    small_batches(docs.sparkSession)
    rows = docs.select(_body()).mapInArrow(_stretch_batches, "kind string, stretch string")
    rows = rows.groupBy("kind", F.sha2("stretch", 256).alias("hash")).agg(F.first("stretch").alias("stretch"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("hash"))).filter(F.col("rank") <= SAMPLE)
    return learn([r.stretch for r in ranked.select("stretch").distinct().orderBy("stretch").collect()])


def _body() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def described(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text."""
    base, _ = base_spans(text)
    return base, sorted(base + decode(proposals(text, weights, _disjoint(base))))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_KIND = [pa.int64()] * 5 + [pa.string()] * 2


def _span_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    for whole in batches:
        for batch in slices(whole, "body"):
            rows = []
            for body in batch.column("body"):
                body = body.as_py()
                if not telling(body):
                    rows.append(nothing)
                    continue
                base, spans = described(body.decode("utf-8", "replace"), weights)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(BASE_KINDS))]
                rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, _KIND[1:], strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """Of each row of docs, its spans. weights: of fit(), by default learnt from docs themselves."""
    small_batches(docs.sparkSession)
    model = fit(docs) if weights is None else weights
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _body()).mapInArrow(lambda it: _span_batches(it, model), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


QUERIES = {"op11_pii": query}
