"""Numbers and names that a summary has and its source hasn't. Plain Python over one pair of texts.

A source is read once into evidence: exact decimals of every reading of its figures, of its number
words and shares, and the operands that may be added up. A summary's figure is supported if one of
its own readings is among them, is spelled out, or is a sum or difference of operands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a unit after a figure multiplies it by.
UNITS = {
    "тис": 10**3, "thousand": 10**3, "tisuć": 10**3, "k": 10**3,
    "млн": 10**6, "million": 10**6, "milijun": 10**6, "m": 10**6,
    "млрд": 10**9, "billion": 10**9, "milijard": 10**9, "bn": 10**9, "b": 10**9,
}
# What a word of scale after a number word multiplies it by.
WORD_UNITS = {
    "тисяч": 10**3, "тис": 10**3, "thousand": 10**3, "tisuć": 10**3,
    "мільйон": 10**6, "млн": 10**6, "million": 10**6, "milijun": 10**6,
    "мільярд": 10**9, "млрд": 10**9, "billion": 10**9, "milijard": 10**9,
}
# Beginnings of the words that spell a number.
NUMBER_WORDS = {
    1: ["один", "одна", "одне", "перш", "one", "first", "jedan", "jedna", "prv"],
    2: ["два", "дві", "двох", "двоє", "друг", "two", "second", "both", "dva", "dvije", "drug"],
    3: ["три", "трьох", "троє", "трет", "three", "third", "tri", "treć"],
    4: ["чотир", "четвер", "four", "četir"],
    5: ["п'ят", "five", "pet"],
    6: ["шість", "шести", "шост", "six", "šest"],
    7: ["сім", "семи", "сьом", "seven", "sedam"],
    8: ["вісім", "восьм", "eight", "osam"],
    9: ["дев'ят", "nine", "devet"],
    10: ["десят", "ten", "deset"],
    11: ["одинадцят", "eleven", "jedanaest"],
    12: ["дванадцят", "twelve", "dvanaest"],
    13: ["тринадцят", "thirteen", "trinaest"],
    14: ["чотирнадцят", "fourteen", "četrnaest"],
    15: ["п'ятнадцят", "fifteen", "petnaest"],
    20: ["двадцят", "twenty", "dvadeset"],
    100: ["сотн", "hundred", "stotin"],
    1000: ["тисяч", "thousand", "tisuć"],
}
# Whole words that count things, which may be added up.
COUNT_WORDS = {
    1: "один одна одне одну одного одної одній одному одним одною one jedan jedna jedno",
    2: "два дві двох двоє двом двома two dva dvije",
    3: "три трьох троє трьом трьома three tri",
    4: "чотири чотирьох четверо чотирьом чотирма four četiri",
    5: "п'ять п'яти п'ятьох п'ятеро п'ятьма five",
    6: "шість шести шістьох шестеро шістьма six šest",
    7: "сім семи сімох семеро сімома seven sedam",
    8: "вісім восьми вісьмох восьмеро вісьмома eight osam",
    9: "дев'ять дев'яти дев'ятьох дев'ятеро дев'ятьма nine devet",
    10: "десять десяти десятьох десятеро десятьма ten deset",
}
# Words for shares, in percent, and for a half that follows a number.
SHARES = {
    50: ["половин", "half", "polovic"],
    25: ["чверт", "quarter", "četvrtin"],
    33: ["третин", "one third", "a third", "trećin"],
    20: ["п'ята частин", "п'яту частин", "one fifth", "a fifth", "petin"],
    10: ["десята частин", "десяту частин", "one tenth", "a tenth", "desetin"],
}
HALVES = ["з половиною", "and a half", "i pol"]
# Letters of both alphabets that stand for one sound; vowels stand for nothing.
LETTER_CLASSES = ["бb", "вwv", "гґзжhgzž", "дđd", "кцчхcčćkq", "лl", "мm", "нn", "пp", "рr", "сшщsšx", "тt", "фf"]
# A capitalised word that opens no sentence; what names the country; names read out of short forms.
NAME = re.compile(r"(?<![.!?…:;«\"„“(\n—–-])(?<![.!?…:;«\"„“(\n—–-] )\b([А-ЯІЇЄҐЁ][а-яіїєґё'’ʼ]{3,})")
COUNTRY = re.compile("україн|украин|ukrain|ukrajin", re.IGNORECASE)
IMPLIED = re.compile("росі|київ|києв|верховн|рад[аиіу]|міноборон", re.IGNORECASE)

#: Figures that may be added up, besides counted words; totals up to which a spelled "one" helps.
OPERANDS, SMALL_TOTAL = 12, 10
SOUNDS = 3

_CLASS = {letter: group for group in LETTER_CLASSES for letter in group}
_COUNT = {word: Decimal(n) for n, words in COUNT_WORDS.items() for word in words.split()}
_MASK = re.compile(r"https?://\S+|\b0x[0-9a-f]+(?:(?:…|\.\.\.)[0-9a-f]+)?\b", re.IGNORECASE)
_SPACES = "[    ]"
_FIGURE = re.compile(rf"\d+(?:{_SPACES}\d{{3}}(?!\d))*(?:[.,]\d+)*")
_UNIT = re.compile(r"\s*(" + "|".join(sorted((u for u in UNITS if len(u) > 1), key=len, reverse=True)) + r"|[kmb](?![a-z]))", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")


def _same_apostrophes(text: str) -> str:
    return re.sub("[’ʼ]", "'", text)


@dataclass(frozen=True)
class Figure:
    """A figure with all it can mean: readings of its separators, each also multiplied by the unit after it."""

    readings: tuple[Decimal, ...]
    factor: int
    start: int
    end: int

    @property
    def values(self) -> set[Decimal]:
        return {r * f for r in self.readings for f in {1, self.factor}}

    @property
    def label(self) -> str:
        return f"{self.readings[0]:.6f}".rstrip("0").rstrip(".")


def _readings(written: str, decimal_first: bool) -> tuple[Decimal, ...]:
    """What digits with separators mean. Groups of three after a separator are thousands, or decimals."""
    written = re.sub(_SPACES, "", written)
    parts = re.split("[.,]", written)
    out = []
    if len(parts) == 2:
        out.append(Decimal(f"{parts[0]}.{parts[1]}"))
    if len(parts) == 1 or all(len(p) == 3 for p in parts[1:]):
        out.append(Decimal("".join(parts)))
    if len(parts) > 2:
        out.append(Decimal(f"{parts[0]}.{parts[1]}"))
    return tuple(out if decimal_first else out[::-1])


def figures(text: str, decimal_first: bool = True) -> Iterator[Figure]:
    for m in _FIGURE.finditer(text):
        unit = _UNIT.match(text, m.end())
        yield Figure(_readings(m[0], decimal_first), UNITS[unit[1].lower()] if unit else 1, m.start(), unit.end() if unit else m.end())


def _year(x: Decimal) -> bool:
    return x == x.to_integral_value() and 1900 <= x <= 2100


class Evidence:
    """What a source says of numbers."""

    def __init__(self, source: str, year: int) -> None:
        self.text = _same_apostrophes(source.lower())
        self.year = year
        self.words = [(m[0], m.end()) for m in _WORD.finditer(self.text)]

    @staticmethod
    def _of(text: str) -> set[Decimal]:
        """Figures in all readings, their parts on their own (a date is no decimal), and with a half after them."""
        out = {Decimal(n) for n in re.findall(r"\d+", text)}
        for f in figures(text):
            out |= f.values
            if text[f.end :].lstrip().startswith(tuple(HALVES)):
                out |= {r + Decimal("0.5") for r in f.readings}
        return out

    @cached_property
    def spelled(self) -> set[int]:
        """Numbers some word stands for."""
        return {n for n, starts in NUMBER_WORDS.items() if any(w.startswith(tuple(starts)) for w, _ in self.words)}

    @cached_property
    def worded(self) -> set[Decimal]:
        """Numbers of several words: scaled, with a half, shares."""
        out = set()
        for word, end in self.words:
            after = self.text[end:].lstrip() if self.text[end : end + 1].isspace() else ""
            for n, starts in NUMBER_WORDS.items():
                if word.startswith(tuple(starts)):
                    out |= {Decimal(n * f) for u, f in WORD_UNITS.items() if after.startswith(u)}
                    if after.startswith(tuple(HALVES)):
                        out.add(n + Decimal("0.5"))
        running = " " + " ".join(w for w, _ in self.words)
        return out | {Decimal(share) for share, phrases in SHARES.items() if any(" " + p in running for p in phrases)}

    @cached_property
    def known(self) -> set[Decimal]:
        return self._of(self.text) | self.worded | {Decimal(x) for x in (0, 1, self.year - 1, self.year, self.year + 1)}

    @cached_property
    def operands(self) -> list[Decimal]:
        """The least figures and all counted words; what is there twice counts twice. Addresses and hashes are no figures."""
        text = _MASK.sub(" ", self.text)
        counted = [_COUNT[m[0]] for m in _WORD.finditer(text) if m[0] in _COUNT]
        given = sorted(x for x in self._of(text) | Evidence(text, self.year).worded if x > 1 and not _year(x))
        chosen = {*given[:OPERANDS], *counted}
        seen = Counter(map(Decimal, re.findall(r"\d+", text))) + Counter(counted)
        return [x for x in sorted(chosen) for _ in range(min(seen[x], 2) or 1)]

    def adds_up(self, total: Decimal) -> bool:
        """A sum of two or three operands or a difference of two. Years take no part; a one only in small sums."""
        if _year(total):
            return False
        use = self.operands if total <= SMALL_TOTAL else [x for x in self.operands if x != 1]
        sums = any(sum(some) == total for n in (2, 3) for some in combinations(use, n))
        return sums or any(b - a == total for a, b in combinations([x for x in use if x != 1], 2))

    def carries(self, figure: Figure) -> bool:
        values = figure.values
        return bool(values & self.known) or any(r == n for r in figure.readings for n in self.spelled) or any(map(self.adds_up, values))


def skeleton(word: str, size: int = SOUNDS) -> str:
    """The consonants that open a word, one letter for each class, the same in both alphabets."""
    word = word.lower()
    cyrillic = any("а" <= c <= "я" or c in "іїєґё" for c in word)
    out = ""
    for i, c in enumerate(word):
        before, after = word[i - 1 : i] if i else "", word[i + 1 : i + 2]
        if cyrillic:
            if c == "д" and after == "ж":
                continue  # one sound
        elif c == "p" and after == "h":
            c = "f"
        elif c == "j" and not before:
            c = "ž"
        elif c == "h":
            if not before:
                c = "k" if after and after not in "aeiouy" else c
            elif before not in "aeiouy" or not after or after not in "aeiouy":
                continue  # it only marks the letter before it
        group = _CLASS.get(c)
        if group:
            out += group[0]
        if len(out) == size:
            break
    return out


def _unknown_names(summary: str, source: str) -> list[str]:
    if sum("а" <= c <= "я" or c in "іїєґё" for c in source.lower()) < 20:  # a foreign source: names can't be compared
        return ["Україна"] if COUNTRY.search(summary) and not COUNTRY.search(source) else []
    told = [skeleton(w, 99) for w in re.split(r"[^\w'’ʼ]|[\d_]", source) if w]
    out = []
    for m in NAME.finditer(summary):
        sounds = skeleton(m[1])
        free = not m.start() or not sounds or COUNTRY.search(m[1]) or IMPLIED.match(m[1])
        if not free and not any(t.startswith(sounds) for t in told):
            out.append(m[1])
    return out


def unsupported(summary: str, source: str, year: int) -> list[str]:
    """Figures and names that a summary has and its source has not. year: the present."""
    summary = summary.rstrip(" …")
    evidence = Evidence(source, year)
    return [*dict.fromkeys(f.label for f in figures(summary) if not evidence.carries(f)), *_unknown_names(summary, source)]


def unsupported_column(summary: Column, source: Column, year: int) -> Column:
    """The same over Arrow batches."""

    @F.arrow_udf("array<string>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([unsupported(x or "", y or "", year) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.string()))

    return run(summary, source)
