import base64
import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import Row

import corpus_pipeline
from newsloom.llm import byte_bpe, mixing, quality
from newsloom.llm.common import documents
from tests.llm.test_minhash import brute
from tests.llm.test_mixing import brute_period

SF = "/root/testdata/sf0.01"


def brute_mixture(rows):
    """doc_ids with repetitions, in order; rows: (doc_id, source)."""
    by_source = {}
    for i, s in rows:
        by_source.setdefault(s, []).append(i)
    names = sorted(by_source)
    for s in names:
        by_source[s].sort(key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    period, weight = mixing.PERIOD, [len(by_source[s]) ** mixing.ALPHA for s in names]
    exact = [w / sum(weight) * (period - len(names)) for w in weight]
    quota = [1 + int(x) for x in exact]
    for k in sorted(range(len(names)), key=lambda k: (-(exact[k] % 1), names[k]))[: period - sum(quota)]:
        quota[k] += 1
    blocks = [[by_source[s][i : i + mixing.BLOCK_ROWS] for i in range(0, len(by_source[s]), mixing.BLOCK_ROWS)] for s in names]
    one, given, out = brute_period(quota, period), Counter(), []
    slot = 0
    while any(given[k] < len(b) for k, b in enumerate(blocks)):
        k = one[slot % period]
        out += blocks[k][given[k] % len(blocks[k])]
        given[k] += 1
        slot += 1
    return out


def test_run_matches_brute_force(spark):
    docs = documents(spark, SF)
    scored = quality.quality_scores(docs, documents(spark, SF, "labels"))
    good = {r.doc_id for r in scored.filter("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id in good]
    assert 0.6 * docs.count() < len(rows) < docs.count()
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        if key not in best or (-len(r.text), r.doc_id) < (-len(best[key].text), best[key].doc_id):
            best[key] = r
    rows = list(best.values())
    near = brute([(r.doc_id, r.text) for r in rows], 5, 80)
    rows = [r for r in rows if near[r.doc_id][1] == r.doc_id]
    expect = brute_mixture([(r.doc_id, r.source) for r in rows])
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in rows}
    got = corpus_pipeline.run(spark, SF).orderBy("shard", "place").collect()
    assert [r.doc_id for r in got] == expect
    for r in got:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, "Some text that is here", None, "a"), (None, None, None, None), (2, "", "en", "b"), (2, "", "en", "b"), (3, "w " * 100_000, "en", "a"), (1, "Some text that is here", None, "a")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang=k, source=s, n_chars=0, rec=1, best=2) for i, t, k, s in rows], "doc_id long, text string, lang string, source string, n_chars long, rec int, best int")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SF)
            assert at.columns == docs.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, at, SF).count() == 0) == empty
