"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (``features``; numpy over the bytes of a whole
batch). Labelled rows give, for each class, count, sums and cross products, added up on the
executors; only these few hundred numbers reach the driver. Class covariances shrink towards the
pooled covariance (POOL) and its diagonal (DIAGONAL); their Cholesky factors are kept with the
model. The score is the logistic function of the difference of the classes' Gaussian log densities
(Mahalanobis distance and log determinant from the factors) plus the log prior odds, divided by
TEMPERATURE, which flattens the posteriors that correlated statistics make too sure.

Defined results: a null text is scored as the empty text; labels of a document with several rows in
the labels table count once, as their minimum; null labels and null doc_ids are ignored; if a class
has fewer than two learnable rows every score is 0.5. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Words, binary_values, documents, file_based, materialise, mix64, row_key, slices, small_batches, without

THRESHOLD = 0.3
POOL, DIAGONAL = 0.5, 0.1
TEMPERATURE = 2.0
NAMES = ["log_words", "word_length", "upper", "punctuation", "rare_symbols", "repeated_words", "distinct_words", "distinct_trigrams", "bare_symbols", "line_length", "longest_run"]
K = len(NAMES)

_BYTES = np.arange(256)
_PUNCT = np.isin(_BYTES, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_RARE = _PUNCT & ~np.isin(_BYTES, list(b".,;:'\"-()?!"))
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_ASCII_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _ASCII_UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0xC2)  # a lead byte stands for its character
_POINT = (_BYTES & 0xC0) != 0x80


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Different keys of each owner."""
    both = mix64(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    new = np.ones(len(both), bool)
    new[1:] = both[order][1:] != both[order][:-1]
    return np.bincount(owner[order[new]], minlength=n).astype(float)


def features(column: pa.Array) -> np.ndarray:
    """A row of K statistics for each text."""
    raw, at = binary_values(column)
    n = len(at) - 1
    if not n:
        return np.zeros((0, K))
    words = Words(raw, at)
    body, edge = words.body, at - at[0]

    def count(mask: np.ndarray) -> np.ndarray:
        """Of each text; reduceat gives an empty range the value at its start."""
        return np.where(edge[1:] > edge[:-1], np.add.reduceat(np.append(mask, False), edge[:-1], dtype=np.int64), 0).astype(float)

    upper = _ASCII_UPPER[body]
    if len(body) > 1:  # U+00C0 to U+00DE
        upper[1:] |= (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E)
    letters, points = count(_LETTER[body]), count(_POINT[body])
    told = np.append(_LETTER[body] | _DIGIT[body], False)
    told = np.logical_or.reduceat(told, np.column_stack([words.start, words.end]).ravel())[::2] if len(words.start) else np.zeros(0, bool)
    n_words = np.diff(words.first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(words.first))
    bare = np.bincount(owner, ~told, n)
    same = np.zeros(len(owner), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    runs = np.zeros(n)
    if len(owner):
        begin = np.flatnonzero(~same)
        np.maximum.at(runs, owner[begin], np.diff(np.append(begin, len(owner))))
    three = np.zeros(n)
    if len(owner) > 2:
        whole = owner[2:] == owner[:-2]
        gram = mix64(mix64(words.hash[:-2] * np.uint64(3) + words.hash[1:-1]) * np.uint64(5) + words.hash[2:])
        three = _distinct(gram[whole], owner[2:][whole], n)
    least = np.maximum(n_words, 1)
    share = lambda x, of: np.sqrt(x / np.maximum(of, 1))
    return np.column_stack([
        np.log1p(n_words),
        np.log1p(points / least),
        share(count(upper), letters),
        share(count(_PUNCT[body]), points),
        share(count(_RARE[body]), points),
        share(np.bincount(owner, same, n), n_words),
        share(_distinct(words.hash, owner, n), n_words),
        share(three, n_words - 2),
        share(bare, n_words),
        np.log1p(points / (1 + count(body == 10))),
        np.log1p(runs),
    ])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of classes 0 and 1; None where a class is missing."""

    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    constants: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
        if (counts < 2).any():
            return cls()
        means = sums / counts[:, None]
        scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / counts.sum()
        floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
        whiten, constants = [], []
        for c in (0, 1):
            sigma = (1 - POOL) * scatter[c] / counts[c] + POOL * pooled
            sigma = (1 - DIAGONAL) * sigma + DIAGONAL * floor
            factor = np.linalg.cholesky(sigma)
            whiten.append(np.linalg.inv(factor))
            constants.append(np.log(counts[c] / counts.sum()) - np.log(np.diag(factor)).sum())
        return cls(means, np.array(whiten), np.array(constants))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None or not len(x):
            return np.full(len(x), 0.5)
        log = [self.constants[c] - 0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip((log[0] - log[1]) / TEMPERATURE, -50, 50)))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "body"):
            x = features(batch.column("body"))
            kept = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), K).cast(pa.list_(pa.float64()))], names=[*kept, "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 + K + K * K))
    for batch in batches:
        y = batch.column("quality").to_numpy(zero_copy_only=False)
        x = batch.column("x").flatten().to_numpy().reshape(-1, K)
        for c in (0, 1):
            mine = x[y == c]
            total[c] += np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()])
    label, place = np.meshgrid([0, 1], np.arange(total.shape[1]), indexing="ij")
    yield pa.RecordBatch.from_arrays([pa.array(label.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(total.ravel())], names=["label", "place", "value"])


def text_bytes() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", *row_key(docs), text_bytes().alias("body")).mapInArrow(_feature_batches, "doc_id long, _file long, _row long, x array<double>")


def fit(table: DataFrame, labels: DataFrame) -> Discriminant:
    """From a feature table and the learnable rows of labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = table.join(known, "doc_id").select("quality", "x").mapInArrow(_moments, "label int, place int, value double")
    total = np.zeros((2, 1 + K + K * K))
    for r in rows.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        total[r.label, r.place] = r.value
    return Discriminant.fit(total[:, 0], total[:, 1 : 1 + K], total[:, 1 + K :].reshape(2, K, K))


KEPT = ["doc_id", "_file", "_row", "held_out"]


def score_table(table: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, K)
            yield pa.RecordBatch.from_arrays([*map(b.column, KEPT), pa.array(model.score(x))], names=[*KEPT, "score"])

    rows = table.select("doc_id", "_file", "_row", held_out().alias("held_out"), "x").mapInArrow(run, "doc_id long, _file long, _row long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows with their places. Texts are read once: the features stay in a table of ours."""
    table = materialise(feature_table(docs), "features")
    return score_table(table, fit(table, labels))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return _scored(file_based(docs), labels).drop("_file", "_row")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, all columns. Rows never move."""
    docs = file_based(docs)
    return without(docs, _scored(docs, labels).filter("predicted = 0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


QUERIES = {"op5_quality": query}
