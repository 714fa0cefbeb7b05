"""Operational aggregates: volume, silence, health, rule hits, engagement, schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.clock import hhmm, hours_between, minute_label, within


def totals(items: DataFrame, as_of: Column) -> DataFrame:
    """A01; what waits counts paused sources too."""
    return items.agg(F.count_if(within(F.col("processed_at"), as_of, hours=24)).alias("total"), F.count_if(~F.col("sent")).alias("pending"))


def by_source(items: DataFrame, sources: DataFrame, categories: DataFrame, as_of: Column) -> DataFrame:
    """Volumes of each source; items of a vanished source don't count."""
    recent = within(F.col("processed_at"), as_of, hours=24)
    counts = items.groupBy("source_id").agg(  # one row of each source leaves a task, before any join
        F.count_if(recent).alias("cnt"), F.count_if(~F.col("sent")).alias("unsent_cnt"), F.count_if(F.col("duplicate_of").isNotNull() & recent).alias("muted_cnt")
    )
    named = counts.join(sources.select(F.col("id").alias("source_id"), "name", "category"), "source_id")
    order = categories.select(F.col("name").alias("category"), F.col("sort_order").alias("category_order"))
    return named.join(order, "category", "left").filter("cnt > 0 OR unsent_cnt > 0").withColumn("category_order", F.coalesce("category_order", F.lit(999)))


def by_category(per_source: DataFrame, categories: DataFrame) -> DataFrame:
    """A04."""
    emoji = categories.filter("is_active").select(F.col("name").alias("category"), "emoji")
    busiest = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("k"), "name", "cnt", "unsent_cnt")))
    rows = per_source.groupBy("category").agg(F.sum("cnt").alias("total"), F.sum("muted_cnt").alias("muted"), busiest.alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["name"], x["cnt"].cast("string"), x["unsent_cnt"].cast("string"))), " ")
    return rows.join(emoji, "category", "left").select("category", F.coalesce("emoji", F.lit("📌")).alias("emoji"), "total", "muted", text.alias("sources"))


def silent(items: DataFrame, sources: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Active, unmuted sources without a post for that long; never posted counts."""
    last = items.groupBy(F.col("source_id").alias("id")).agg(F.max("processed_at").alias("last_item_at"))
    rows = sources.filter("status = 'active' AND NOT silent_alert_muted").join(last, "id", "left")
    rows = rows.filter(F.col("last_item_at").isNull() | ~within(F.col("last_item_at"), as_of, hours=hours))
    return rows.withColumn("hours_silent", hours_between(as_of, F.col("last_item_at")).cast("bigint"))


def health(items: DataFrame, as_of: Column) -> DataFrame:
    """A06."""
    week = within(F.col("processed_at"), as_of, days=7)
    return items.groupBy("source_id").agg(
        F.round(hours_between(as_of, F.max("processed_at")), 6).alias("hours_since"), F.count_if(week).alias("week_total"), F.count_if(week & F.col("duplicate_of").isNotNull()).alias("week_muted")
    )


def rule_hits(items: DataFrame, rules: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """A07, of rules that still exist."""
    hits = items.filter(F.col("blocked_reason").isNotNull() & within(F.col("processed_at"), as_of, days=days)).groupBy(F.col("blocked_reason").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return rules.join(hits, "rule", "left").select("rule", "label", F.coalesce("n", F.lit(0)).alias("n"))


def views_baseline(items: DataFrame, as_of: Column, days: int = 7, least: int = 10) -> DataFrame:
    """Median views of each source's recent posts that went out."""
    out = items.filter(F.col("views").isNotNull() & F.col("sent") & F.col("duplicate_of").isNull() & F.col("blocked_reason").isNull() & (F.col("published_at") > as_of - F.make_dt_interval(F.lit(days))))
    return out.groupBy("source_id").agg(F.median("views").alias("usual"), F.count(F.lit(1)).alias("posts")).filter((F.col("posts") >= least) & (F.col("usual") > 0))


def engagement(queue: DataFrame, baseline: DataFrame, top: int = 5) -> DataFrame:
    """The waiting posts that stand out most against their own source."""
    rows = queue.filter(F.col("views").isNotNull()).join(baseline, "source_id").withColumn("ratio", F.round(F.col("views") / F.col("usual"), 6))
    return rows.orderBy(F.col("ratio").desc(), "id").limit(top)


def digest_health(log: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """A09; a day without any digest is an alert too."""
    rows = log.filter(within(F.col("sent_at"), as_of, hours=hours))
    bad = F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("status"))))
    return rows.agg(F.count(F.lit(1)).alias("digests"), F.coalesce(F.sum("items_total"), F.lit(0)).alias("items"), F.count_if(F.col("status") != "ok").alias("not_ok"), F.array_join(bad, ",").alias("statuses")).withColumn(
        "alert", (F.col("digests") == 0) | (F.col("not_ok") > 0)
    )


def category_times_text(categories: DataFrame, times: DataFrame) -> DataFrame:
    """A10/S11."""
    per = times.groupBy(F.col("category").alias("name")).agg(F.array_join(F.array_sort(F.collect_list(hhmm(F.col("hour"), F.col("minute")))), ",").alias("digest_time"))
    return categories.filter("is_active").join(per, "name", "left").withColumn("digest_time", F.coalesce("digest_time", F.lit("")))


def schedule_slots(categories: DataFrame, times: DataFrame) -> DataFrame:
    """A11/J06."""
    rows = times.join(categories.filter("is_active").select(F.col("name").alias("category"), "sort_order"), "category")
    inside = F.array_sort(F.collect_list(F.struct("sort_order", "category")))
    return rows.groupBy(hhmm(F.col("hour"), F.col("minute")).alias("at")).agg(F.array_join(F.transform(inside, lambda x: x["category"]), ",").alias("categories"))


def timetable_groups(with_times: DataFrame) -> DataFrame:
    """Categories with the same times together, the largest group first; without times last."""
    inside = F.array_sort(F.collect_list(F.struct("sort_order", "name")))
    groups = with_times.groupBy("digest_time").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(inside, lambda x: x["name"]), ",").alias("categories"))
    w = Window.partitionBy().orderBy((F.col("digest_time") == "").asc(), F.col("size").desc(), "digest_time")  # groups of times: a handful of rows
    return groups.withColumn("place", F.row_number().over(w))


def next_slot(moments: DataFrame, times: DataFrame) -> DataFrame:
    """The first slot later than each minute of the day, wrapping to tomorrow's first."""
    slots = F.array_sort(F.collect_set(F.col("hour") * 60 + F.col("minute")))
    one = times.agg(slots.alias("slots")).first()  # a timetable: at most 1440 entries
    all_slots = F.array(*[F.lit(x) for x in one.slots]) if one.slots else F.array().cast("array<int>")
    later = F.filter(all_slots, lambda x: x > F.col("minute"))
    return moments.withColumn("wait", F.coalesce(F.array_min(later), F.array_min(all_slots) + 1440) - F.col("minute")).withColumn("at", minute_label(F.pmod(F.col("minute") + F.col("wait"), F.lit(1440))))


def source_counts(sources: DataFrame, quiet: DataFrame) -> DataFrame:
    """A13."""
    q = quiet.groupBy("category").agg(F.count(F.lit(1)).alias("quiet"))
    per = sources.groupBy("category").agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("status") == "paused").alias("paused"))
    return per.join(q, "category", "left").withColumn("quiet", F.coalesce("quiet", F.lit(0)))


def home_state(sources: DataFrame, waiting: DataFrame, quiet: DataFrame, log: DataFrame) -> DataFrame:
    """A14/L04 as one row of single values."""
    last = log.agg(F.max_by("status", "sent_at").alias("last_status"), F.date_format(F.max("sent_at"), "yyyy-MM-dd HH:mm:ss").alias("last_digest"))
    parts = [
        waiting.agg(F.count(F.lit(1)).alias("pending")),
        quiet.agg(F.count(F.lit(1)).alias("quiet")),
        sources.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("active", "pending", "error", "paused")]).withColumnRenamed("pending", "joining"),
        last,
    ]
    out = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:  # one row each
        out = out.join(p.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


def top_stories(survivors: DataFrame, duplicates: DataFrame, least: int = 3) -> DataFrame:
    """Stories by how many sources told them. survivors: id, source_name; duplicates: primary_id, source_name."""
    names = survivors.select("id", "source_name").unionByName(duplicates.select(F.col("primary_id").alias("id"), "source_name").join(survivors.select("id"), "id", "left_semi"))
    return names.groupBy("id").agg(F.countDistinct("source_name").alias("told_by")).filter(F.col("told_by") >= least)


def failure_streaks(polls: DataFrame, gap_minutes: int) -> DataFrame:
    """Runs of failed polls of a source with no success and no long gap between. polls: source_id, at, failed, seq."""
    w = Window.partitionBy("source_id").orderBy("at", "seq")
    gap = (F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(w))) / 60
    new = F.when(F.col("failed") & F.coalesce(F.lag("failed").over(w), F.lit(False)) & (gap <= gap_minutes), 0).otherwise(1)
    runs = polls.withColumn("new", new).withColumn("run", F.sum("new").over(w)).filter("failed")
    return runs.groupBy("source_id", "run").agg(F.count(F.lit(1)).alias("failures"), F.min("at").alias("begin"), F.max("at").alias("end"))


def reactions_total(counts: Column) -> Column:
    """The sum of a post's reaction counts; null without any list, missing counts are 0."""
    return F.aggregate(F.transform(counts, lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, c: s + c)


OUTCOMES = [("ok", "ok"), ("dead", "quota_dead"), ("rl", "rate_limited"), ("busy", "busy"), ("err", "error")]


def model_usage(calls: DataFrame) -> DataFrame:
    """Calls of each model by how they ended, and the same as one line. calls: tag, outcome."""
    out = calls.groupBy("tag").agg(*[F.count_if(F.col("outcome") == o).alias(short) for short, o in OUTCOMES])
    told = F.concat_ws(" ", *[F.concat(F.lit(f"{short}="), F.col(short)) for short, _ in OUTCOMES])
    return out.withColumn("line", F.concat("tag", F.lit("["), told, F.lit("]")))


def never_posted(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Sources without a post in the store: their first poll is a bootstrap."""
    return sources.join(items.select(F.col("source_id").alias("id")), "id", "left_anti")
