"""Hiding a story's copies: primaries, candidates, confirmation, survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import richness
from newsloom.operators.graph import components, cut, follow
from newsloom.operators.judge import Judge


def rank_key(prefers_telegram: bool = True) -> Column:
    """What makes a post the one that stays; the least wins, the id ends every tie."""
    telegram = F.when(F.col("source_type") == "telegram", 0).otherwise(1) if prefers_telegram else F.lit(1)
    return F.struct(telegram.alias("t"), (-F.col("richness")).alias("r"), F.coalesce(F.col("source_sort_order").cast("double"), F.lit(1e9)).alias("o"), F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("9999")).alias("p"), F.col("id"))


def with_richness(items: DataFrame) -> DataFrame:
    return items.withColumn("richness", richness(F.col("raw_text")))


def candidates(members: DataFrame) -> DataFrame:
    """id, primary_id: the members of a component, of another source than its primary. members: component and rank_key's columns."""
    best = members.groupBy("component").agg(F.min_by(F.struct("id", "source_id"), rank_key()).alias("p"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = members.select("id", "source_id", "component").join(best, "component")
    return rows.filter((F.col("id") != F.col("p.id")) & (F.col("source_id") != F.col("p.source_id"))).select("id", F.col("p.id").alias("primary_id"))


def confirm(asked: DataFrame, judge: Judge, in_digest_line: float, line: float, repeat_line: float) -> DataFrame:
    """Id, primary_id, outcome of each candidate: hidden, update (linked back) or kept.

    asked: id, primary_id, score (null without a vector), shown (the primary went out before), same_category,
    richness, primary_richness, other_night. Cheap certainty comes first; only the rest is judged.
    """
    score = F.coalesce("score", F.lit(0.0))
    richer = F.col("richness") > F.col("primary_richness")
    needed = F.when(~F.col("shown") & F.col("same_category"), in_digest_line).otherwise(line)
    rows = asked.withColumn("night", F.col("shown") & F.col("other_night")).withColumn("sure", (score >= needed) & ~richer)
    open_ = rows.filter("NOT night AND NOT sure").select(F.col("primary_id").alias("a"), F.col("id").alias("b"))
    verdicts = judge.pairs(open_).select(F.col("a").alias("primary_id"), F.col("b").alias("id"), "verdict")
    rows = rows.join(verdicts, ["id", "primary_id"], "left")
    update = F.col("verdict") == "update"
    outcome = (
        F.when(F.col("night"), "kept").when(F.col("sure"), "hidden").when(F.col("verdict") == "same", "hidden")
        .when(update & ~F.col("shown") & ~richer, "hidden").when(update & F.col("shown") & (score >= repeat_line), "hidden")
        .when(update & F.col("shown"), "update").otherwise("kept")
    )
    return rows.withColumn("outcome", outcome).select("id", "primary_id", "verdict", "outcome")


def regroup(kept: DataFrame, members: DataFrame, scores: DataFrame, floor: float) -> DataFrame:
    """Candidates one primary rejected, that clear the floor with the best of them directly: id, survivor_id.

    kept: id, primary_id; members: rank_key's columns and category; scores: a < b, score (of different sources).
    """
    rows = cut(kept.join(members, "id"))
    close = cut(scores.filter(F.col("score") >= floor).select("a", "b"))
    side = lambda p, end: rows.select(F.col("primary_id").alias(f"{p}_primary"), F.col("id").alias(end), F.col("source_id").alias(f"{p}_source"), F.col("category").alias(f"{p}_category"))
    # from the pairs that clear the floor to their ends, not from the rejected to one another
    ends = close.join(side("x", "a"), "a").join(side("y", "b"), "b")
    edges = ends.filter("x_primary = y_primary AND x_source <> y_source AND x_category = y_category").select("a", "b")
    groups = rows.join(components(rows.select("id").distinct(), edges), "id")
    pairs = candidates(groups).select("id", F.col("primary_id").alias("survivor_id"))
    near = close.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    return pairs.withColumn("lo", F.least("id", "survivor_id")).withColumn("hi", F.greatest("id", "survivor_id")).join(near, ["lo", "hi"], "left_semi").select("id", "survivor_id")


def survivors(hidden: DataFrame) -> DataFrame:
    """Each hidden post under a post that isn't hidden itself. hidden: id, primary_id."""
    return follow(hidden.select("id", F.col("primary_id").alias("to"))).select("id", F.col("last").alias("primary_id"))


def duplicate_links(items: DataFrame, sources: DataFrame) -> DataFrame:
    """primary_id, links: name and address of the other sources' copies, in the order sources are shown."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "sort_order")
    dup = items.filter("duplicate_of IS NOT NULL").select("id", "source_id", F.col("duplicate_of").alias("primary_id"), "original_url").join(s, "source_id", "left")
    primary = items.select(F.col("id").alias("primary_id"), F.col("source_id").alias("primary_source"))
    rows = dup.join(primary, "primary_id").filter("source_id <> primary_source")
    ordered = F.array_sort(F.collect_list(F.struct("sort_order", "id", F.coalesce("source_name", F.lit("?")).alias("name"), F.coalesce("original_url", F.lit("")).alias("url"))))
    return rows.groupBy("primary_id").agg(ordered.alias("l")).select("primary_id", F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url"))).alias("links"))
