"""The test tables seen as the engine's tables, and small literal tables.

Everything is lazy: a query that doesn't touch texts doesn't read them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.clock import minutes_after
from newsloom.operators.graph import cut
from newsloom.sources import schemas

EPOCH = "2024-01-01 00:00:00"
#: Of the digests of the test tables: their SQL knows no summer time.
ZONE = "+01:00"
CATEGORY_NAMES = ["feed", "finance", "crypto", "tech"]
#: A source that its items outlive.
VANISHED = 13
EMOJI = ["📰", "💰", "🪙", "💻"]
RULES = [(1, "ads", "Adverts"), (2, "= licensed under", None), (3, "war", "War"), (4, "= er–st", None), (5, "= The", "The"), (6, "=", None), (7, "never", None)]
RULE_CATEGORIES = [(2, "feed"), (2, "tech"), (4, "finance")]
RULE_SOURCES = [(3, 2), (3, 3), (5, 1), (5, 6), (5, 11), (4, 5), (4, 9)]
#: Three days of posts.
ITEMS_A_DIGEST = 108
#: Categories that a source's number stands for in timetables; the last is no category any more.
TIMED = ["feed", "finance", "crypto", "tech", "in en", "in fr", "in de", "gone"]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def literal(self, rows: list[tuple], schema) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @staticmethod
    def source_number(source: Column) -> Column:
        return F.substring(source, 4, 9).cast("bigint")

    @staticmethod
    def category_of(source_id: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, CATEGORY_NAMES)), (source_id % 4 + 1).cast("int"))

    @cached_property
    def every_source(self) -> DataFrame:
        n = F.col("id")
        ids = self.table("documents").select(self.source_number(F.col("source")).alias("id")).distinct()
        return ids.select(
            "id",
            F.when(n % 2 == 0, "telegram").otherwise("rss").alias("type"),
            F.concat(F.lit("src"), n).alias("name"),
            F.when(n % 2 == 0, F.concat(F.lit("@src"), n)).otherwise(F.concat(F.lit("https://src"), n, F.lit(".example.org/feed"))).alias("url"),
            self.category_of(n).alias("category"),
            F.when(n % 10 == 7, "paused").when(n % 10 == 9, "error").otherwise("active").alias("status"),
            (n % 5).cast("int").alias("sort_order"),
            (n % 7).cast("int").alias("fail_count"),
            F.when(n % 2 == 0, F.lit(-1000000000000) - n).alias("chat_id"),
            (n % 11 == 3).alias("silent_alert_muted"),
            F.when(n % 6 == 0, "no merge").when(n % 6 == 4, "Please DO NOT TRANSLATE").when(n % 6 == 5, "don't filter, thanks").alias("prompt_extra"),
            (n * 20).alias("last_message_id"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        return self.every_source.filter(F.col("id") != VANISHED)

    @cached_property
    def posts(self) -> DataFrame:
        """Items without what other tables and other rows say about them: one scan, no join."""
        n, s = F.col("id"), F.col("source_id")
        base = self.table("documents").select(F.col("doc_id").alias("id"), self.source_number(F.col("source")).alias("source_id"), F.col("text").alias("raw_text"))
        at = minutes_after(EPOCH, n * 40)
        published = minutes_after(EPOCH, n * 40 - n * 7 % 240)
        return base.select(
            "id", "source_id",
            self.message_id(F.when(s % 2 == 0, "telegram").otherwise("rss"), F.concat(F.lit("src"), s), n).alias("message_id"),
            F.concat(F.lit("https://example.org/src"), s, F.lit("/"), n).alias("original_url"),
            "raw_text",
            F.when(n % 17 == 0, "").otherwise(F.substring("raw_text", 1, 120)).alias("summary"),
            F.when(n % 29 == 0, "other").otherwise(self.category_of(s)).alias("category"),
            F.when(n % 31 != 0, published).alias("published_at"),
            at.alias("processed_at"),
            (n % 3 != 0).alias("sent"),
            (n % 5).cast("int").alias("classify_attempts"),
            F.when(n % 13 != 0, n * 37 % 1000).alias("views"),
            at.cast("date").alias("digest_day"),
            F.floor(n / ITEMS_A_DIGEST).alias("digest"),
        )

    @cached_property
    def judged(self) -> DataFrame:
        """posts, with the rule that blocked each; no other post is looked at."""
        toxic = self.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("toxic")).distinct()
        reason = F.element_at(F.array(F.lit("ads"), F.lit("war"), F.lit("gone rule")), (F.col("id") % 3 + 1).cast("int"))
        return self.posts.join(toxic, "id", "left").select(*self.posts.columns, F.when(F.col("toxic"), reason).alias("blocked_reason"))

    @cached_property
    def items(self) -> DataFrame:
        """judged, with the first post of the same text."""
        rows = self.judged.join(self._copies, "id", "left")
        return rows.select(*self.posts.columns, F.col("first").alias("duplicate_of"), "blocked_reason")

    @cached_property
    def _copies(self) -> DataFrame:
        """id, first: texts told before. A table whose size is known: joined with all posts, it moves no text while it is small."""
        first = self._digests.groupBy("h").agg(F.min("doc_id").alias("first"))
        return cut(first.join(self._digests, "h").filter("doc_id <> first").select(F.col("doc_id").alias("id"), "first"))

    @cached_property
    def _digests(self) -> DataFrame:
        """A digest of each text, written once: texts are read for it one time."""
        return cut(self.table("documents").select("doc_id", F.md5("text").alias("h")))

    @staticmethod
    def message_id(kind: Column, url: Column, raw_id: Column) -> Column:
        """The identity of a post, from its source's kind and url and its own number."""
        raw = raw_id.cast("string")
        return F.when(kind == "telegram", F.concat_ws("_", F.lit("tg"), url, raw)).otherwise(F.md5(F.concat_ws(":", url, raw)))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))

    @cached_property
    def labelled(self) -> DataFrame:
        """The deterministic judge's knowledge: a label of each vector."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "label")

    @cached_property
    def as_of(self) -> Column:
        """The explicit present: the last processing time, one value."""
        last = self.table("documents").agg(F.max("doc_id")).first()[0]
        return minutes_after(EPOCH, F.lit(last).cast("bigint") * 40)

    @cached_property
    def categories(self) -> DataFrame:
        """Those of the sources, and one of each language, which has no sources."""
        place = F.array_position(F.array(*map(F.lit, CATEGORY_NAMES)), F.col("category")).cast("int")
        told = self.every_source.select("category").distinct()
        told = told.select(F.col("category").alias("name"), F.element_at(F.array(*map(F.lit, EMOJI)), place).alias("emoji"), (place - 1).alias("sort_order"), F.lit(True).alias("is_active"))
        tongues = self.table("documents").filter("lang IS NOT NULL").select("lang").distinct()
        return told.unionByName(tongues.select(F.concat(F.lit("in "), "lang").alias("name"), F.lit("🌐").alias("emoji"), F.lit(4).alias("sort_order"), (F.col("lang") != "de").alias("is_active")))

    @cached_property
    def keyed_events(self) -> DataFrame:
        """events, with the number in their properties."""
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

    @cached_property
    def category_times(self) -> DataFrame:
        """Purchases as entries of a timetable."""
        n = F.col("user_id")
        rows = self.keyed_events.filter("event_type = 'purchase' AND NOT (user_id % 8 = 2 AND k >= 50) AND (user_id % 8 < 4 OR user_id % 3 = 0)")
        return rows.select(F.element_at(F.array(*map(F.lit, TIMED)), (n % 8 + 1).cast("int")).alias("category"), (n % 3 * 6 + 6).cast("int").alias("hour"), F.when(F.col("k") < 50, 0).otherwise(30).alias("minute")).distinct()

    @cached_property
    def legacy_schedules(self) -> DataFrame:
        """Of each user a list of what may be times."""
        part = F.concat((F.col("k") % 30).cast("string"), F.lit(":"), (F.col("event_id") % 70).cast("string")).alias("part")
        told = self.keyed_events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", part))).alias("parts"))
        return told.select(F.concat(F.lit("u"), "user_id").alias("name"), F.array_join(F.transform("parts", lambda p: p["part"]), ", ").alias("digest_time"))

    @cached_property
    def kept_rules(self) -> DataFrame:
        """Rules named after the numbers in events."""
        return self.keyed_events.select("k").distinct().select(F.col("k").alias("word_id"), F.concat(F.lit("rule "), "k").alias("rule"), F.when(F.col("k") % 4 == 0, F.concat(F.lit("Label "), "k")).alias("label"))

    @cached_property
    def kept_rule_categories(self) -> DataFrame:
        return self.keyed_events.filter("event_type = 'purchase' AND k % 3 = 0").select(F.col("k").alias("word_id"), self.category_of(F.col("user_id")).alias("category")).distinct()

    @cached_property
    def kept_rule_sources(self) -> DataFrame:
        return self.keyed_events.filter("event_type = 'click' AND k % 5 <> 0").select(F.col("k").alias("word_id"), (F.col("user_id") % 20).alias("source_id")).distinct()

    @cached_property
    def rules(self) -> DataFrame:
        return self.literal(RULES, schemas.RULES)

    @cached_property
    def rule_categories(self) -> DataFrame:
        return self.literal(RULE_CATEGORIES, schemas.RULE_CATEGORIES)

    @cached_property
    def rule_sources(self) -> DataFrame:
        return self.literal(RULE_SOURCES, schemas.RULE_SOURCES)

    @cached_property
    def digest_log(self) -> DataFrame:
        """Purchases as digests that went out."""
        status = F.when(F.col("k") % 5 == 0, "failed").when(F.col("k") % 5 == 1, "empty").otherwise("ok")
        return self.keyed_events.filter("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("sent_at"), F.col("k").cast("int").alias("items_total"), status.alias("status"))
