"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text is turned into a suffix automaton. A text is
parsed greedily against each automaton into longest matches; the number of phrases times
log2(sample length), per character, estimates the cross entropy. The language needing the fewest
normalised phrases wins (ties: the smaller name).

Text is folded first: letters lower-cased, every run of other characters one space. A text is parsed
whole, in blocks of BLOCK characters that run in lockstep, all languages at once, through one sparse
transition table (the transitions of a state lie at its base plus the symbol, interleaved with those
of others; a slot names the state it belongs to), so a table grows with the samples and not with their
alphabets. A phrase ends where its block ends, which adds at most one phrase in BLOCK characters to
every language alike. Texts of more than PIECE characters are folded and parsed piece by piece.

Bounds (parameters): SAMPLE_TEXTS texts of each of the LANGUAGES lang values with most learnable rows
(ties: the smaller name), one of each of as many hash buckets of doc_id: one of SAMPLE_MIN to SAMPLE_MAX
code points if the bucket has any, else one of another length, of which the first SAMPLE_MAX are
learnt. Of these texts the first SAMPLE_CHARS folded characters are learnt; only languages without a
letter in any of them go unlearnt. A phrase costs as if a sample had SAMPLE_MIN characters at least, or
else a sample of a few would be the cheapest for every text. Only these few texts reach the driver.

Defined results: a null text or one without a letter is `und` with score 0; if nothing can be learnt
every text is `und`; rows with a null doc_id are never learnt from and count as not held out; equal
rows get equal results; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, documents, materialise, slices, small_batches

SAMPLE_TEXTS = 64
SAMPLE_MIN, SAMPLE_MAX = 200, 4000
SAMPLE_CHARS = 40_000
#: Languages that are learnt: those with most learnable rows.
LANGUAGES = 256
BLOCK = 1024
#: Characters of a long text that are parsed at once.
PIECE = 1 << 20
#: How sharply the score falls with the margin: bits of total evidence are capped here.
EVIDENCE_BITS = 30.0


@cache
def fold_table() -> np.ndarray:
    """Lower-case letter of every code point; 32 for what is no letter. Marks belong to their letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(points: np.ndarray) -> np.ndarray:
    """Folded code points with runs of spaces made one."""
    x = fold_table()[points]
    space = x == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = ~space[:1]
    return x[keep]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the root."""
    size = 2 * len(text) + 2
    link, length = [-1] * size, [0] * size
    moves: list[dict[int, int]] = [{}]
    last = 0
    for c in text:
        cur = len(moves)
        moves.append({})
        length[cur] = length[last] + 1
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length[clone] = length[p] + 1
                link[clone] = link[q]
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


def interleaved(moves: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base of each state, state and target of each slot): a state's transition by c is at base + c if that slot is its own.

    States of several transitions go where a draw finds room for all of them, largest first; those of
    one fill the gaps. Base + c is a slot for every c.
    """
    rng = np.random.default_rng(7)
    total = sum(map(len, moves))
    room = int(1.6 * total) + symbols
    owner = np.full(room + 2 * symbols, -1, np.int32)
    target = np.zeros(room + 2 * symbols, np.int32)
    base = np.full(len(moves), symbols, np.int32)
    single = []
    for state in sorted(range(len(moves)), key=lambda k: -len(moves[k])):
        move = moves[state]
        if len(move) == 1:
            single.append(state)
        if len(move) < 2:
            continue
        at = np.fromiter(move, np.int64, len(move))
        while True:
            tried = rng.integers(symbols, room, 16)
            free = np.flatnonzero((owner[tried[:, None] + at] < 0).all(1))
            if len(free):
                break
        start = tried[free[0]]
        base[state] = start
        owner[start + at] = state
        target[start + at] = np.fromiter(move.values(), np.int32, len(move))
    gaps = symbols + np.flatnonzero(owner[symbols : symbols + room] < 0)[: len(single)]
    symbol, to = (np.array([next(iter(f(moves[k]))) for k in single], np.int32) for f in (dict.keys, dict.values))
    owner[gaps], target[gaps], base[single] = single, to, gaps - symbol
    return base, owner, target


class Model:
    """Automata of all languages over one alphabet, stacked into one table."""

    def __init__(self, samples: dict[str, str]) -> None:
        texts = {k: folded(np.frombuffer(v.encode("utf-32-le"), np.uint32))[:SAMPLE_CHARS] for k, v in sorted(samples.items())}
        self.languages = [k for k, v in texts.items() if len(v)]
        letters = np.unique(np.concatenate([texts[k] for k in self.languages])) if self.languages else np.zeros(0, np.uint32)
        symbols = len(letters) + 1  # 0: a character that no sample has
        self.code = np.zeros(0x110000, np.int32)
        self.code[letters] = np.arange(1, symbols)
        parts, begins, self.bits, self.roots, states, slots = [], [], [], [], 0, 0
        for k in self.languages:
            moves = suffix_automaton(self.code[texts[k]].tolist())
            base, owner, target = interleaved(moves, symbols)
            begin = np.full(symbols, states, np.int64)  # an unknown character is a phrase of its own
            begin[list(moves[0])] = np.fromiter(moves[0].values(), np.int64, len(moves[0])) + states
            parts.append((base.astype(np.int64) + slots, np.where(owner < 0, np.int64(-1), owner + np.int64(states)), target + np.int64(states)))
            begins.append(begin)
            self.roots.append(states)
            self.bits.append(np.log2(max(len(texts[k]), SAMPLE_MIN) + 1))
            states += len(base)
            slots += len(owner)
        self.base, self.owner, self.target = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        self.begin = np.stack(begins) if begins else np.zeros((0, symbols), np.int64)

    def phrases(self, symbols: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Phrases of each block and language. blocks: start of each block and the end of the last."""
        starts, sizes = blocks[:-1], np.diff(blocks)
        order = np.argsort(-sizes, kind="stable")  # so that blocks still running are a prefix
        starts, sizes = starts[order], sizes[order]
        running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), side="right")
        roots = np.array(self.roots, np.int64)[:, None]
        state = np.repeat(roots, len(starts), 1)
        count = np.zeros(state.shape, np.int64)
        for j, n in enumerate(running.tolist()):
            now, c = state[:, :n], symbols[starts[:n] + j]
            slot = self.base[now] + c
            goes = self.owner[slot] == now
            count[:, :n] += ~goes | (now == roots)  # a phrase begins after a cut, and where none is open
            state[:, :n] = np.where(goes, self.target[slot], self.begin[:, c])
        out = np.empty((len(starts), len(self.languages)), np.int64)
        out[order] = count.T
        return out

    def _long(self, text: str) -> tuple[np.ndarray, bool]:
        """(phrases of each language, whether there is a letter) of one text, piece by piece."""
        total, lettered, open_ = np.zeros(len(self.languages), np.int64), False, False
        rest = np.zeros(0, np.int32)
        for at in range(0, len(text), PIECE):
            x = fold_table()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le"), np.uint32)]
            letter = x != 32
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            keep[0] |= open_
            open_, lettered = bool(letter[-1]), lettered or bool(letter.any())
            rest = np.concatenate([rest, self.code[x[keep]]])
            whole = len(rest) if at + PIECE >= len(text) else len(rest) // BLOCK * BLOCK
            if whole:
                total += self.phrases(rest, np.append(np.arange(0, whole, BLOCK), whole)).sum(0)
            rest = rest[whole:]
        return total, lettered

    def _short(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of several texts at once."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        x = fold_table()[points]
        letter = x != 32
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        first = np.concatenate([[0], ends[:-1]])
        inside = first[first < len(keep)]
        keep[inside] = letter[inside]  # no space at the start of a text
        at = np.concatenate([[0], np.cumsum(keep)])
        symbols = self.code[x[keep]]
        begin, end = at[first], at[ends]
        has = np.concatenate([[0], np.cumsum(letter)])
        n_blocks = -(-(end - begin) // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(total, owner, self.phrases(symbols, np.concatenate([begin[owner] + index * BLOCK, [at[-1]]])))
        return total, has[ends] > has[first]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        total, lettered = self._short([t if len(t) <= PIECE else "" for t in texts])
        for i, t in enumerate(texts):
            if len(t) > PIECE:
                total[i], lettered[i] = self._long(t)
        names, scores = [], []
        bits = np.array(self.bits)
        for i in range(len(texts)):
            if not lettered[i] or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            cost = total[i] * bits
            best = int(np.argmin(cost))
            odds = np.exp2(-np.minimum(cost - cost[best], EVIDENCE_BITS))
            names.append(self.languages[best])
            scores.append(float(1.0 / odds.sum()))
        return names, scores


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> dict[str, str]:
    """The bounded sample of labelled text of each language.

    Texts are dealt to SAMPLE_TEXTS buckets by a hash; of each bucket one text is learnt from, of SAMPLE_MIN to
    SAMPLE_MAX code points if there is one, else of any length, cut to SAMPLE_MAX.
    """
    text = F.col("text")
    labelled = docs.select("text", "lang", "doc_id", F.xxhash64("doc_id").alias("h"), ((F.length(text) >= SAMPLE_MIN) & (F.length(text) <= SAMPLE_MAX)).alias("fit")).filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.substring("text", 1, SAMPLE_MAX).rlike(r"\p{L}")
    )
    pick = F.min(F.struct((~F.col("fit")).alias("other"), "h")).alias("pick")
    with Scratch(docs.sparkSession):
        buckets = materialise(labelled.groupBy("lang", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("b")).agg(pick, F.count(F.lit(1)).alias("n")), "buckets")
        most = buckets.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES)
        picks = buckets.join(most.select("lang"), "lang").select("lang", "pick.h", (~F.col("pick.other")).alias("fit"))  # LANGUAGES * SAMPLE_TEXTS rows at most
        rows = labelled.join(F.broadcast(picks), ["lang", "h", "fit"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, SAMPLE_MAX)).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        out.setdefault(r.lang, []).append(r.text)
    return {k: "\n".join(v) for k, v in out.items()}


_MODELS: dict[int, Model] = {}


def predict_batches(batches: Iterator[pa.RecordBatch], token: int, samples: dict[str, str]) -> Iterator[pa.RecordBatch]:
    if token not in _MODELS:
        _MODELS.clear()
        _MODELS[token] = Model(samples)
    model = _MODELS[token]
    for whole in batches:
        for batch in slices(whole, "body"):
            names, scores = model.predict([(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column("body")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    samples = sample(docs) if samples is None else samples
    token = hash(tuple(sorted(samples.items()))) % sys.maxsize
    shared = spark.sparkContext.broadcast(samples)  # bounded: SAMPLE_TEXTS * SAMPLE_MAX characters of each of LANGUAGES
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(lambda it: predict_batches(it, token, shared.value), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


QUERIES = {"op1_language_id": query}
