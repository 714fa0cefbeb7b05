import hashlib
import re

import duckdb
import pytest
from pyspark.sql import Row

from newsloom.llm import exact_dedup
from newsloom.llm.exact_dedup import ExactIndex, keep_first_copies

SF = "/root/testdata/sf0.001"
ROWS = [
    (5, "a b", "x"), (3, "ab", "x"), (9, "a\tb\x0b ", "x"),  # equal when white space is gone; the longest stays
    (8, "c d", "x"), (7, "c\nd", "x"), (7, "c d", "x"),  # a tie of lengths, then of ids
    (1, None, "x"), (2, "", "x"), (4, " \r\n", "x"),  # nothing at all; white space is longer
    (6, "a b", "x"), (10, "single", "x"), (None, "loner", "x"), (None, "both", "x"), (11, "both", "x"), (None, "none", "x"), (None, "none", "x"),
    (12, "long " * 300_000, "x"), (13, "long" * 300_000, "x"),
]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    """For each row (keep_id, group_size, sha), and how many rows of its group stay."""
    out = []
    for i, text, _ in rows:
        mine = [(-len(t or ""), j is None, j or 0, j) for j, t, _ in rows if norm(t) == norm(text)]
        out.append((i, min(mine)[3] if len(mine) > 1 else i, len(mine), hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [32, 1])
def test_groups_match_brute_force(spark, size):
    """One-byte digests collide all the time: contents are told apart by their bytes."""
    docs = spark.createDataFrame([Row(doc_id=i, text=t, size=x) for i, t, x in ROWS], "doc_id long, text string, size string")
    got = ExactIndex(docs, digest_bytes=size).members.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(ROWS)
    assert sum(r.kept for r in got) == len({norm(t) for _, t, _ in ROWS})
    assert all(r.kept for r in got if r.group_size == 1)


def test_many_collisions(spark):
    rows = [(i, f"text {i % 700}" + " " * (i % 3), "x") for i in range(2000)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    index = ExactIndex(docs, digest_bytes=1)
    assert index.mixed is not None
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in index.members.collect()], key=str) == brute(rows)


def test_small_memtables(spark, monkeypatch):
    assert [len(b) for b in exact_dedup.flush(iter([]), 4)] == []
    docs = spark.createDataFrame([Row(doc_id=i, text=f"t{i % 9}") for i in range(100)], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "MEMTABLE_BYTES", 1)
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 3)
    got = exact_dedup.exact_dedup(docs).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(i, i % 9, i < 9) for i in range(100)}


def test_rows_that_stay_keep_all_columns(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, size=x) for i, t, x in ROWS], "doc_id long, text string, size string")
    kept = keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({norm(t) for _, t, _ in ROWS})
    assert {9, 7, 4, 6, 10, 11, 12} <= {r.doc_id for r in kept.collect()}
    assert keep_first_copies(docs.limit(0)).count() == 0 and exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_oracle_agrees(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expect = con.sql(exact_dedup.ORACLE)
    got = exact_dedup.query(spark, SF).select(*expect.columns).collect()
    assert sorted(map(tuple, got)) == sorted(expect.fetchall())
