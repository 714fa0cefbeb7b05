"""The queue of posts waiting for a digest, and the pools a digest is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.clock import within


def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with what their source says; items of a vanished source stay, with nulls."""
    s = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"), F.col("url").alias("source_url"),
        F.col("sort_order").alias("source_sort_order"), F.col("status").alias("source_status"), F.col("prompt_extra").alias("source_prompt_extra"),
    )
    return items.join(s, "source_id", "left")


def unsent(items: DataFrame, sources: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Waiting posts of sources that aren't paused, or gone."""
    rows = items.filter(~F.col("sent"))
    if categories:
        rows = rows.filter(F.col("category").isin(categories))
    return with_source(rows, sources).filter(F.coalesce("source_status", F.lit("")) != "paused")


def queue_order() -> list[Column]:
    """L01, with the id as the last tie-break."""
    return [F.col("category").asc_nulls_first(), F.col("source_sort_order").asc_nulls_first(), F.col("source_id").asc_nulls_first(), F.col("published_at").asc_nulls_first(), F.col("id").asc()]


def positions(queue: DataFrame) -> DataFrame:
    """The place of each post in its day's digest."""
    return queue.withColumn("position", F.row_number().over(Window.partitionBy("digest_day").orderBy(*queue_order())))


def blank(text: Column) -> Column:
    """Nothing but white space of any kind (not only U+0020)."""
    return text.isNull() | ~text.rlike(r"(?U)\S")


def needs_summary(items: DataFrame) -> DataFrame:
    """P02."""
    return items.filter(blank(F.col("summary")) & ~blank(F.col("raw_text")))


def sent_but_empty(items: DataFrame, sources: DataFrame, limit: int = 5) -> DataFrame:
    """The newest posts that went out without a summary."""
    return needs_summary(with_source(items.filter("sent"), sources)).orderBy(F.col("id").desc()).limit(limit)


def newest_of_each_source(items: DataFrame, limit: int) -> DataFrame:
    """L02."""
    w = Window.partitionBy("source_id").orderBy(F.col("id").desc())
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def vector_pool(items: DataFrame, vectors: DataFrame, sources: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Recent posts with a vector that no rule blocked; hidden duplicates belong to it."""
    rows = items.filter(within(F.col("processed_at"), as_of, hours=hours) & F.col("blocked_reason").isNull())
    return with_source(rows, sources).join(vectors, "id")


def text_pool(items: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Recent posts that went out, with or without a vector."""
    return items.filter(F.col("sent") & F.col("blocked_reason").isNull() & within(F.col("processed_at"), as_of, hours=hours))


def summary_batch(waiting: DataFrame, limit: int = 6) -> DataFrame:
    """The posts one pass summarises: the first of the queue that need it."""
    return needs_summary(waiting).orderBy(*queue_order()).limit(limit)
