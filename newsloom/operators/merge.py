"""One line for several posts of a source on one story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_cosine(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Component, least cosine of any two of its members. members: id, component; pairs: every pair of a source with its score."""
    m = members.select("id", "component")
    both = pairs.join(m.select(F.col("id").alias("a"), "component"), "a").join(m.select(F.col("id").alias("b"), F.col("component").alias("other")), "b")
    return both.filter("component = other").groupBy("component").agg(F.min("score").alias("least"))


def merged_lines(members: DataFrame) -> DataFrame:
    """One row of each component: the newest post's address and time, the newest summary there is, the earlier posts.

    members: component, id, summary, original_url, published_at.
    """
    when = F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    rows = members.withColumn("moment", when)
    has_url, has_summary = F.coalesce("original_url", F.lit("")) != "", F.trim(F.coalesce("summary", F.lit(""))) != ""
    newest = F.struct("moment", "id")
    out = rows.groupBy("component").agg(
        F.array_sort(F.collect_list("id")).alias("item_ids"),
        F.max_by("original_url", F.when(has_url, newest)).alias("url"),
        F.max_by("moment", F.when(has_url, newest)).alias("moment"),
        F.max("moment").alias("latest"),
        F.max_by("summary", F.when(has_summary, newest)).alias("summary"),
        F.array_sort(F.collect_set(F.when(has_url, F.struct("moment", F.col("original_url").alias("url"))))).alias("posts"),
        F.max(F.when(has_url, F.lit(True))).alias("linked"),
        F.max(F.when(has_summary, F.lit(True))).alias("told"),
    )
    linked, told = F.coalesce("linked", F.lit(False)), F.coalesce("told", F.lit(False))
    out = out.withColumn("url", F.when(linked, F.col("url"))).withColumn("moment", F.when(linked, F.col("moment")).otherwise(F.col("latest"))).withColumn("summary", F.when(told, F.col("summary")).otherwise(""))
    # a member of the very moment of the newest is the same post under a second address
    return out.withColumn("earlier", F.filter("posts", lambda p: p["moment"] != F.col("moment"))).drop("posts", "latest", "linked", "told")


def earlier_links(lines: DataFrame, most: int = 4, dated_hours: int = 12, known: Column | None = None) -> DataFrame:
    """The earlier posts a line links, and how many more there are; one of the day before is never cut.

    known: what must hold besides for the first earlier post's time to count.
    """
    n = F.size("earlier")
    tail = F.slice("earlier", F.greatest(n - most + 1, F.lit(1)), most)
    first = F.get("earlier", F.lit(0))
    hours = (F.unix_timestamp("moment") - F.unix_timestamp(first["moment"])) / 3600
    dated = F.when(n > most, F.concat(F.slice("earlier", 1, 1), F.slice("earlier", F.greatest(n - most + 2, F.lit(1)), most - 1)))
    shown = F.when((n > most) & F.coalesce(F.try_subtract(F.try_to_timestamp("moment"), F.try_to_timestamp(first["moment"])).isNotNull() & (hours >= dated_hours) & (F.lit(True) if known is None else known), F.lit(False)), dated).otherwise(F.when(n > 0, tail).otherwise(F.col("earlier")))
    return lines.withColumn("shown", shown).withColumn("more", F.greatest(n - F.size("shown"), F.lit(0)))


def by_topic(items: DataFrame, groups: DataFrame, least: int = 4) -> DataFrame:
    """Id, component: the posts of a source without vectors, grouped as a provider says; fewer than `least` stay alone.

    items: digest, source_id, id; groups: digest, source_id, group_no, ids. Posts left out are alone, a post
    named twice is in its first group.
    """
    enough = items.groupBy("digest", "source_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    asked = items.join(enough, ["digest", "source_id"], "left_semi")
    named = groups.select("digest", "source_id", "group_no", F.explode("ids").alias("id")).join(asked, ["digest", "source_id", "id"], "left_semi")
    first = named.groupBy("digest", "source_id", "id").agg(F.min("group_no").alias("group_no"))
    heads = first.groupBy("digest", "source_id", "group_no").agg(F.min("id").alias("component"))
    told = first.join(heads, ["digest", "source_id", "group_no"]).select("id", "component")
    return items.select("id").join(told, "id", "left").withColumn("component", F.coalesce("component", "id"))
