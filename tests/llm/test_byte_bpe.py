import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

from newsloom.llm import byte_bpe

PATH = public_tokenizers.path(byte_bpe.RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_agrees_with_the_library(reference):
    rng = random.Random(5)
    alphabet = ["'", "s", "t", "re", "ll", "ve", "x", "É", "7", "Ⅷ", " ", "  ", "\n", "\t", " ", "　", "!", "%", "日本", "😀", "\0", "'s", "́", "\x1c", "the ", "\r\n"]
    texts = ["", " ", "\n\n", "it's we'll  'sit' \n 's", "x" * 700, "ab" * 400 + "  "]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    tool = byte_bpe.codec(PATH)
    for text, ids in zip(texts, tool.encode(texts), strict=True):
        assert ids == reference.encode_ordinary(text), repr(text)
        assert tool.decode(ids) == text.encode()
    ids = tool.encode(["a tiny story"])[0]
    assert b"".join(b"a tiny story"[a:b] for a, b in tool.offsets(ids)) == b"a tiny story"


def test_scan_is_the_running_composition():
    rng = random.Random(6)
    elements, table, _, _, n = byte_bpe.monoid()
    import numpy as np

    x = elements[[rng.randrange(len(elements)) for _ in range(1000)]]
    now, expect = 0, []
    for e in x.tolist():
        now = int(table[now * n + e])
        expect.append(now)
    assert byte_bpe.scan(x, block=7).tolist() == expect
    assert byte_bpe.scan(np.array([], np.uint16)).tolist() == []


def test_rows(spark, reference):
    rows = [Row(doc_id=1, text="He's here", ids="x"), Row(doc_id=2, text=None, ids="x"), Row(doc_id=2, text="", ids=None), Row(doc_id=None, text="He's here", ids="x"), Row(doc_id=3, text="long " * 300_000, ids="x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(byte_bpe.digests(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert len(got) == 5
    for r, text in zip(got, ["He's here", "He's here", "", "", "long " * 300_000], strict=True):
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.digests(docs.limit(0)).count() == 0
    tokens = byte_bpe.tokens(docs.filter("doc_id = 1")).first()
    assert tokens.ends[-1] == len("He's here") and tokens.ids == reference.encode_ordinary("He's here")


def test_long_texts_in_portions(reference, monkeypatch):
    rng = random.Random(7)
    alphabet = ["'", "s", "ll", "x", "É", "7", " ", "  ", "\n", "!", "日本", "😀", "'re", "the "]
    texts = ["".join(rng.choices(alphabet, k=n)) for n in (0, 1, 5, 40, 300, 900)] + ["y" * 70, " " * 50, "a" * 30 + "'s" * 20]
    for size in (1, 3, 16):
        monkeypatch.setattr(byte_bpe, "PIECE", size)
        for text, portions in zip(texts, byte_bpe.codec(PATH).portions(texts), strict=True):
            assert [i for ids in portions for i in ids] == reference.encode_ordinary(text), (size, text)


def test_equal_texts_share_an_encoding(spark, tmp_path):
    rows = [Row(doc_id=i, text=["one text", "another one", None, ""][i % 4]) for i in range(40)] + [Row(doc_id=None, text="one text")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = byte_bpe.tokens(docs).collect()
    assert len(got) == 41 and len({(r.shard, r.place) for r in got}) == 41
    ids = {tuple(r.ids) for r in got}
    assert len(ids) == 3 and all((r.n_tokens, r.ends) == (len(r.ids), []) or r.ends[-1] in (8, 11) for r in got)
    assert byte_bpe.tokens(docs.limit(0)).count() == 0


def test_the_cache_is_bounded_in_bytes(reference, monkeypatch):
    rng = random.Random(3)
    codec = byte_bpe.Codec(PATH)
    texts = ["".join(rng.choices("日本語中文字化け", k=300)) for _ in range(50)] + [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(400)) for _ in range(20)]
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 1 << 20)
    for t in texts:
        assert codec.encode([t]) == [reference.encode_ordinary(t)]
        assert max(map(len, codec.cache), default=0) <= byte_bpe.CACHED_PIECE
        assert sum(200 + len(p) + 36 * len(ids) for p, ids in codec.cache.items()) == codec.cached <= 2 << 20
