"""From surviving posts to an ordered, grouped digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.graph import counted_cut, cut

LINES_PER_SOURCE = 50


def grouped(items: DataFrame) -> DataFrame:
    """Digest, category, source name (two sources of one name are one group) with the posts in order."""
    name = F.coalesce("source_name", F.lit("Unknown"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("moment"), "id")))
    return items.groupBy("digest", "category", name.alias("source_name")).agg(F.transform(ordered, lambda x: x["id"]).alias("ids"), F.count(F.lit(1)).alias("n"))


def capped(items: DataFrame, most: int = LINES_PER_SOURCE) -> DataFrame:
    """What fits; the rest stays waiting."""
    name = F.coalesce("source_name", F.lit("Unknown"))
    w = Window.partitionBy("digest", "category", name).orderBy(F.col("published_at").asc_nulls_first(), "id")
    return items.withColumn("line", F.row_number().over(w)).filter(F.col("line") <= most)


def category_order(names: DataFrame, last: list[str], minute: Column) -> DataFrame:
    """Categories by place; in the morning (05:00 to 11:59) some move to the end. names: name, sort_order, emoji."""
    morning = minute.between(300, 719)
    w = Window.partitionBy().orderBy(F.when(morning & F.col("name").isin(last), 1).otherwise(0), "sort_order", "name")  # categories: a handful of rows
    return names.withColumn("place", F.row_number().over(w))


def reply_parents(replies: DataFrame, store: DataFrame, shown: DataFrame) -> DataFrame:
    """Id, parent_id, shown_as: the post answered, and the line of another source that tells it now.

    replies: id, reply_to; store: id, message_id, source_id, duplicate_of; shown: id, source_id.
    """
    parent = store.select(F.col("message_id").alias("reply_to"), F.col("id").alias("parent_id"), F.col("source_id").alias("parent_source"), F.col("duplicate_of").alias("told_by"))
    line = shown.select(F.col("id").alias("told_by"), F.col("source_id").alias("line_source"))
    out = replies.join(parent, "reply_to").join(line, "told_by", "left")
    return out.select("id", "parent_id", F.when(F.col("line_source") != F.col("parent_source"), F.col("told_by")).alias("shown_as"))


def threads(lines: DataFrame) -> DataFrame:
    """Digest, id, place, nested: each answer right under its original, depth first; loops go out once, at the end.

    lines: digest, id, position, parent (null or elsewhere: a top line). A thread is walked as an Euler tour,
    a list in which every line is entered and left once; ranking these lists by pointer jumping gives
    places in rounds that grow with the logarithm of the longest thread, and two rows a line, however deep.
    """
    here = lines.select("digest", F.col("id").alias("parent"), F.lit(True).alias("here"))
    sibling = Window.partitionBy("digest", "up").orderBy("position", "id")
    rows = lines.join(here, ["digest", "parent"], "left").select("digest", "id", "position", F.when(F.col("here"), F.col("parent")).alias("up"))
    rows = cut(rows.withColumn("nth", F.row_number().over(sibling)).withColumn("right", F.lead("id").over(sibling)))
    first = rows.filter("up IS NOT NULL AND nth = 1").select("digest", F.col("up").alias("id"), F.col("id").alias("child"))
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    after_enter = F.coalesce(enter("child"), leave("id"))
    after_leave = F.when(F.col("up").isNotNull(), F.coalesce(enter("right"), leave("up")))
    steps = F.array(
        F.struct(enter("id").alias("step"), after_enter.alias("next"), F.lit(1).cast("bigint").alias("entered"), F.lit(None).cast("bigint").alias("top")),
        F.struct(leave("id").alias("step"), after_leave.alias("next"), F.lit(0).cast("bigint").alias("entered"), F.when(F.col("up").isNull(), F.col("id")).alias("top")),
    )
    tour = rows.join(first, ["digest", "id"], "left").select("digest", F.explode(steps).alias("s")).select("digest", "s.*")
    now, moving = counted_cut(tour, F.col("next").isNotNull())
    most, rounds = rows.count(), 0
    while moving and 2**rounds <= 2 * most:  # who still moves then is in a loop, or answers one
        ahead = now.select("digest", F.col("step").alias("next"), F.col("next").alias("further"), F.col("entered").alias("more"), F.col("top").alias("its_top"))
        jumped = now.join(ahead, ["digest", "next"], "left").select("digest", "step", F.col("further").alias("next"), (F.col("entered") + F.coalesce("more", F.lit(0))).alias("entered"), F.coalesce("top", "its_top").alias("top"))
        now, moving = counted_cut(jumped, F.col("next").isNotNull())
        rounds += 1
    told = rows.join(now.filter("step % 2 = 0").select("digest", F.floor(F.col("step") / 2).alias("id"), "entered", F.when(F.isnull("next"), F.col("top")).alias("top")), ["digest", "id"])
    loop = F.col("top").isNull()
    heads = told.filter("top = id").select("digest", F.col("id").alias("top"), F.col("position").alias("top_position"), F.col("entered").alias("size"))
    down = Window.partitionBy("digest").orderBy("top_position", "top")
    heads = heads.withColumn("start", F.sum("size").over(down) - F.col("size"))
    whole = heads.groupBy("digest").agg(F.sum("size").alias("walked"))
    out = told.join(heads, ["digest", "top"], "left").join(whole, "digest", "left")
    late = F.row_number().over(Window.partitionBy("digest", loop).orderBy("position", "id"))
    place = F.when(loop, F.coalesce("walked", F.lit(0)) + late).otherwise(F.col("start") + F.col("size") - F.col("entered") + 1)
    return out.select("digest", "id", place.cast("int").alias("place"), (F.col("up").isNotNull() & ~loop).alias("nested"))
