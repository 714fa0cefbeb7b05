"""What happens to posts between a poll and the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.clock import hours_between

MAX_AGE_HOURS, LATE_FEED_HOURS = 48, 168
FIRST_SHOWN = 10


def triage_entries(entries: DataFrame, as_of: Column, late_hosts: list[str], first_shown: int = FIRST_SHOWN) -> DataFrame:
    """ST03-ST05, W01: which feed entries are shown and which are stored as retired.

    entries: source_id, position, url, new_source, published_at, raw_text. Too old entries retire (a
    missing date is young); of a new source only the first fresh ones are shown.
    """
    limit = F.when(text.host_listed(F.col("url"), late_hosts), LATE_FEED_HOURS).otherwise(MAX_AGE_HOURS)
    rows = entries.withColumn("late", F.coalesce(hours_between(as_of, F.col("published_at")) > limit, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("source_id", "late").orderBy("position"))
    rows = rows.withColumn("rank", rank).withColumn("retired", F.col("late") | (F.col("new_source") & (F.col("rank") > first_shown)))
    return rows.withColumn("summary", F.when(F.col("retired"), F.substring("raw_text", 1, 200)))


def gap_report(posts: DataFrame, as_of: Column) -> DataFrame:
    """Posts skipped as too old, of channels polled before. posts: source_id, published_at, last_message_id."""
    old = posts.filter((hours_between(as_of, F.col("published_at")) > MAX_AGE_HOURS) & (F.col("last_message_id") > 0))
    return old.groupBy("source_id").agg(F.count(F.lit(1)).alias("skipped"))


def after_bookmark(posts: DataFrame, limit: int) -> DataFrame:
    """The newest posts above each source's bookmark. posts: source_id, message_no, last_message_id."""
    fresh = posts.filter(F.col("message_no") > F.coalesce("last_message_id", F.lit(0)))
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("message_no").desc()))).filter(F.col("rank") <= limit)


def collapse_albums(messages: DataFrame) -> DataFrame:
    """One post of each album: the first with a caption, else the first; its size. messages: album, seq, caption."""
    key = F.struct((F.col("caption") == "").alias("bare"), "seq")
    return messages.groupBy("album").agg(F.min_by("seq", key).alias("seq"), F.min_by("caption", key).alias("caption"), F.count(F.lit(1)).alias("size"))


def deleted_posts(links: DataFrame, answers: DataFrame, batch: int = 200) -> DataFrame:
    """Posts that are gone. A batch of several of which none is left tells nothing. links: url; answers: peer, number, empty."""
    peer, number = text.post_link(F.col("url"))
    rows = links.select("url", peer.alias("peer"), number.alias("number")).filter("peer IS NOT NULL")
    rows = rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("peer").orderBy("number")) - 1) / batch))
    rows = rows.join(answers, ["peer", "number"], "left").withColumn("empty", F.coalesce("empty", F.lit(False)))
    whole = Window.partitionBy("peer", "batch")
    n, gone = F.count(F.lit(1)).over(whole), F.count_if("empty").over(whole)
    return rows.withColumn("trust", ~((n > 1) & (n == gone))).filter("empty AND trust").select("url")


def folder_audit(folder: DataFrame, sources: DataFrame) -> DataFrame:
    """Chat, verdict: 'stale' in the folder only, 'missing' tracked only, 'unknown' without a chat id."""
    tracked = sources.filter("type = 'telegram'").select(text.raw_channel(F.col("chat_id")).alias("chat"), "name")
    known = tracked.filter("chat IS NOT NULL")
    inside = folder.select(text.raw_channel(F.col("chat_id")).alias("chat")).distinct()
    stale = inside.join(known, "chat", "left_anti").select("chat", F.lit(None).cast("string").alias("name"), F.lit("stale").alias("verdict"))
    missing = known.join(inside, "chat", "left_anti").select("chat", "name", F.lit("missing").alias("verdict"))
    unknown = tracked.filter("chat IS NULL").select("chat", "name", F.lit("unknown").alias("verdict"))
    return stale.unionByName(missing).unionByName(unknown)


def defer_empty(items: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Posts still without a summary wait while young; old ones go out as their first line."""
    from newsloom.operators.queue import blank

    empty = blank(F.col("summary")) & ~blank(F.col("raw_text"))
    age = hours_between(as_of, F.coalesce("processed_at", "published_at")) / 24
    rows = items.withColumn("deferred", empty & F.coalesce(age < days, F.lit(False)))
    first = F.split_part(F.substring(text.strip(F.col("raw_text")), 1, 80), F.lit("\n"), F.lit(1))
    return rows.withColumn("summary", F.when(empty & ~F.col("deferred"), F.concat(F.lit("⚠️ "), first)).otherwise(F.col("summary")))


def rest_of_page(posts: DataFrame, as_of: Column, page: int = 100) -> DataFrame:
    """Posts of a page that a poll has seen before, newest first: as many as the page has room for after the
    new ones, up to the first that is too old. posts: source_id, message_no, published_at, last_message_id."""
    w = Window.partitionBy("source_id").orderBy(F.col("message_no").desc())
    seen = F.col("message_no") <= F.coalesce("last_message_id", F.lit(0))
    rows = posts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= page)  # the page: newest posts of any kind
    old = F.coalesce(hours_between(as_of, F.col("published_at")) > MAX_AGE_HOURS, F.lit(False))
    before = F.max(F.when(seen & old, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("stopped", before == 1).filter(seen & ~F.col("stopped")).drop("stopped")


def skip_to_head(entries: DataFrame, store: DataFrame) -> DataFrame:
    """ST09: what a resumed feed offers that isn't stored, as retired posts: it starts from now. entries: message_id, raw_text."""
    new = entries.filter(F.trim(F.coalesce("raw_text", F.lit(""))) != "").join(store.select("message_id"), "message_id", "left_anti")
    return new.withColumn("sent", F.lit(True)).withColumn("summary", F.substring("raw_text", 1, 200))
