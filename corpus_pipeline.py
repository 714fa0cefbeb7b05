"""From raw documents to a mixed, tokenised training corpus.

Five stages, each over all that its predecessor kept; every result is written as Parquet and read
again as the next stage's documents.

1. quality: the classifier is fitted on the learnable rows of `labels`; what it rejects goes.
2. exact: of equal texts one row stays.
3. near: of each group linked by five-word shingles (similarity 0.8 or more) one row stays.
4. mixture: sources are interleaved to target shares (rows ** 0.7). Files read one after the other
   are the mixture; small sources start again so that the shares hold until every row has been
   placed, so a row of a small source may be in it more than once.
5. tokens: byte-level BPE ids of each placed row, decoded again as a check, with its place. Each text
   is encoded once, however often it is placed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.byte_bpe import tokens
from newsloom.llm.common import Scratch, documents, drop_table
from newsloom.llm.exact_dedup import keep_first_copies
from newsloom.llm.minhash import keep_one_of_each
from newsloom.llm.mixing import mixed_documents
from newsloom.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, documents(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokenise)]
#: The classifier and the tokeniser can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:  # a stage's own tables go when its result is written
            kept = scratch.keep(stage(spark, docs, sf_dir), name)
        if docs is not first:
            drop_table(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
