import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from newsloom.llm import quality
from newsloom.llm.common import documents

SF = "/root/testdata/sf0.01"


def brute_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, points = len(words), len(text)
    letters = sum(c.isalpha() for c in text)
    punct = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    rare = sum(c in "#$%&*+/<=>@[\\]^_`{|}~" for c in text)
    runs, run = [0], 0
    for i, w in enumerate(words):
        run = run + 1 if i and w == words[i - 1] else 1
        runs.append(run)
    share = lambda x, of: math.sqrt(x / max(of, 1))
    return [
        math.log1p(n), math.log1p(points / max(n, 1)), share(sum(c.isupper() for c in text), letters), share(punct, points), share(rare, points),
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), share(len(set(words)), n), share(len(set(zip(words, words[1:], words[2:], strict=False))), n - 2),
        share(sum(not any(c.isalnum() for c in w) for w in words), n), math.log1p(points / (1 + text.count("\n"))), math.log1p(max(runs)),
    ]


def test_features_match_brute_force():
    texts = ["", "one", "A a a B\nÉté | 12 %% x", "to to to to!! GO", " \t\n", "x y z x y z x y z", "ß"]
    got = quality.features(pa.array([t.encode() for t in texts], pa.binary()))
    assert np.allclose(got, [brute_features(t) for t in texts])
    assert quality.features(pa.array([], pa.binary())).shape == (0, quality.K)


def test_scores_are_gaussian_log_odds():
    rng = np.random.default_rng(1)
    x = [rng.normal(c, 1 + c, (50, quality.K)) for c in (0, 1)]
    model = quality.Discriminant.fit(np.array([50.0, 50.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    pooled = sum(np.cov(a.T, bias=True) * 50 for a in x) / 100
    logs = []
    for a in x:
        sigma = (1 - quality.POOL) * np.cov(a.T, bias=True) + quality.POOL * pooled
        sigma = (1 - quality.DIAGONAL) * sigma + quality.DIAGONAL * np.diag(np.diag(pooled))
        d = x[0] - a.mean(0)
        logs.append(np.log(0.5) - 0.5 * np.linalg.slogdet(sigma)[1] - 0.5 * (d @ np.linalg.inv(sigma) * d).sum(1))
    assert np.allclose(model.score(x[0]), 1 / (1 + np.exp((logs[0] - logs[1]) / quality.TEMPERATURE)))


def test_held_out_and_stage(spark):
    docs, labels = documents(spark, SF), documents(spark, SF, "labels")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert docs.count() == quality.quality_scores(docs, labels).count()
    held = [r for r in rows if r.held_out]
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in held) / len(held) > 0.95
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert {r.doc_id for r in rows if r.predicted == 1} == kept & {r.doc_id for r in rows}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_odd_rows(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text=None, x=[1.0], quality=1), Row(doc_id=1, text="", x=[1.0], quality=1), Row(doc_id=None, text="a " * 500_000, x=None, quality=0)], "doc_id long, text string, x array<double>, quality int")
    labels = documents(spark, SF, "labels")
    assert sorted(r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()) == [0.5] * 3
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 3
