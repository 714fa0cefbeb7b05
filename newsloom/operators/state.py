"""State changes as pure functions: (table, facts) -> table.

Plain Parquet has no UPDATE; a change is a projection over the table joined with the facts it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(store: DataFrame, incoming: DataFrame, key: str, arrival: list[Column]) -> DataFrame:
    """The incoming rows that get in: the first of each key, none whose key is stored."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*arrival))).filter("_n = 1").drop("_n")
    return first.join(store.select(key), key, "left_anti")


def seen(incoming: DataFrame, store: DataFrame, key: str = "message_id") -> DataFrame:
    """J08."""
    return incoming.join(store.select(key), key, "left_semi")


def unseen(incoming: DataFrame, store: DataFrame, key: str = "message_id") -> DataFrame:
    """J09."""
    return incoming.join(store.select(key), key, "left_anti")


def mark_duplicates(items: DataFrame, facts: DataFrame) -> DataFrame:
    """M03. facts: id, primary_id."""
    out = items.join(facts.select("id", "primary_id"), "id", "left")
    hit = F.col("primary_id").isNotNull()
    return out.withColumn("sent", F.col("sent") | hit).withColumn("duplicate_of", F.coalesce("primary_id", "duplicate_of")).drop("primary_id")


def mark_blocked(items: DataFrame, facts: DataFrame) -> DataFrame:
    """M04. facts: id, reason."""
    out = items.join(facts.select("id", "reason"), "id", "left")
    hit = F.col("reason").isNotNull()
    return out.withColumn("sent", F.col("sent") | hit).withColumn("blocked_reason", F.coalesce("reason", "blocked_reason")).drop("reason")


def discard_queue(items: DataFrame, source_ids: DataFrame) -> DataFrame:
    """What these sources have waiting counts as sent, gets a summary from its text and loses its vector."""
    out = items.join(source_ids.select("source_id", F.lit(True).alias("_gone")).distinct(), "source_id", "left")
    hit = F.coalesce("_gone", F.lit(False)) & ~F.col("sent")
    empty = F.trim(F.coalesce("summary", F.lit(""))) == ""
    out = out.withColumn("summary", F.when(hit & empty, F.substring("raw_text", 1, 200)).otherwise(F.col("summary")))
    return out.withColumn("keeps_vector", ~hit).withColumn("discarded", hit).withColumn("sent", F.col("sent") | hit).drop("_gone")


def prune(items: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Without sent posts older than that."""
    old = F.col("processed_at") < as_of - F.make_dt_interval(F.lit(days))
    return items.filter(~(F.col("sent") & F.coalesce(old, F.lit(False))))


def refresh_counters(items: DataFrame, counters: DataFrame) -> DataFrame:
    """The latest counters of posts that still wait. counters: id, views, seen_at, seq."""
    latest = counters.groupBy("id").agg(F.max_by("views", F.struct("seen_at", "seq")).alias("new_views"), F.max("seen_at").alias("engagement_at"))
    waiting = items.filter(~F.col("sent")).join(latest, "id", "left_semi").select("id").join(latest, "id")
    return items.join(waiting, "id", "left").withColumn("views", F.when(F.col("engagement_at").isNotNull(), F.col("new_views")).otherwise(F.col("views"))).drop("new_views")


def advance_bookmarks(sources: DataFrame, polled: DataFrame) -> DataFrame:
    """Bookmarks only ever grow. polled: source_id, message_no."""
    top = polled.groupBy(F.col("source_id").alias("id")).agg(F.max("message_no").alias("top"))
    return sources.join(top, "id", "left").withColumn("last_message_id", F.greatest("last_message_id", "top")).drop("top")


def revive_feeds(sources: DataFrame, most_failures: int | None = None) -> DataFrame:
    """The failed feeds that get another try."""
    rows = sources.filter("type = 'rss' AND status = 'error'")
    return rows if most_failures is None else rows.filter(F.col("fail_count") < most_failures)


def remove_source_rules(rule_sources: DataFrame, source_id: int) -> DataFrame:
    """The source leaves rules that name others too; a rule for it alone keeps it, and so judges nothing."""
    shared = rule_sources.filter(F.col("source_id") != source_id).select("word_id").distinct()
    gone = rule_sources.filter(F.col("source_id") == source_id).join(shared, "word_id", "left_semi")
    return rule_sources.join(gone, ["word_id", "source_id"], "left_anti")


def move_category(links: DataFrame, old: str, new: str) -> DataFrame:
    """M13 on a bridge table: renamed links merge with those that are there."""
    return links.withColumn("category", F.when(F.col("category") == old, new).otherwise(F.col("category"))).distinct()


def reassign(items: DataFrame, source_id: int, category: str) -> DataFrame:
    """Only what still waits moves with its source."""
    return items.withColumn("category", F.when((F.col("source_id") == source_id) & ~F.col("sent"), category).otherwise(F.col("category")))


def place_at_bottom(sources: DataFrame) -> DataFrame:
    """M15 for every source: the place it gets below all others of its category. Two rows of a category tell it."""
    w = Window.partitionBy("category").orderBy(F.col("sort_order").desc_nulls_last(), "id")
    top = sources.select("category", "id", "sort_order").withColumn("n", F.row_number().over(w)).filter("n <= 2")
    first, second = F.max(F.when(F.col("n") == 1, F.struct("id", "sort_order"))), F.max(F.when(F.col("n") == 2, F.col("sort_order")))
    held = top.groupBy("category").agg(first.alias("_first"), second.alias("_second"))
    others = F.when(F.col("_first.id") == F.col("id"), F.col("_second")).otherwise(F.col("_first.sort_order"))
    return sources.join(held, "category", "left").withColumn("bottom", F.coalesce(others, F.lit(-1)) + 1).select(*sources.columns, "bottom")


def moved_up(sources: DataFrame, names: list[str]) -> DataFrame:
    """Each named source swaps places with its upper neighbour; places are numbered from 0."""
    w = Window.partitionBy("category").orderBy(F.col("sort_order").asc_nulls_first(), "name")
    ranked = sources.withColumn("place", F.row_number().over(w) - 1)
    mine = F.col("name").isin(names)
    below = F.lead(mine).over(w)
    new = F.when(mine & (F.col("place") > 0), F.col("place") - 1).when(F.coalesce(below, F.lit(False)) & ~mine, F.col("place") + 1).otherwise(F.col("place"))
    return ranked.withColumn("new_order", new)


def split_schedule(rows: DataFrame) -> DataFrame:
    """Name, minutes of the day from a legacy comma list; each once."""
    from newsloom.functions.clock import parse_times

    return rows.select("name", F.explode(parse_times(F.col("digest_time"))).alias("minute")).distinct()


def toggle(links: DataFrame, toggled: DataFrame, keys: list[str]) -> DataFrame:
    """Symmetric difference."""
    return links.select(*keys).join(toggled.select(*keys), keys, "left_anti").unionByName(toggled.select(*keys).join(links.select(*keys), keys, "left_anti"))


def delivered(messages: DataFrame) -> DataFrame:
    """Messages up to the first that failed. messages: digest, seq, ok."""
    w = Window.partitionBy("digest").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("ok_so_far", F.min(F.col("ok").cast("int")).over(w) == 1).filter("ok_so_far").drop("ok_so_far")


def source_changes(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Failures in a row since the last success, and the last status, name, address and chat written.

    facts: id, seq, kind ('fail', 'ok', 'status', 'name', 'url' or 'chat_id'), value.
    """
    healthy = facts.filter("kind = 'ok'").groupBy("id").agg(F.max("seq").alias("ok_at"))
    fails = facts.filter("kind = 'fail'").join(healthy, "id", "left").filter("ok_at IS NULL OR seq > ok_at").groupBy("id").agg(F.count(F.lit(1)).alias("new_fails"))
    fields = ["status", "name", "url", "chat_id"]
    written = facts.filter(F.col("kind").isin(fields)).groupBy("id").agg(*[F.max_by(F.when(F.col("kind") == f, F.col("value")), F.when(F.col("kind") == f, F.col("seq"))).alias(f"new_{f}") for f in fields])
    out = sources.join(healthy, "id", "left").join(fails, "id", "left").join(written, "id", "left")
    before = F.when(F.col("ok_at").isNull(), F.col("fail_count")).otherwise(0)
    out = out.withColumn("fail_count", (before + F.coalesce("new_fails", F.lit(0))).cast("int"))
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"new_{f}").cast(sources.schema[f].dataType), F.col(f)))
    return out.select(*sources.columns)


def set_prompt(sources: DataFrame, category: str, prompt: str | None) -> DataFrame:
    """The hint of all active sources of a category; `changed` marks them, for the count."""
    hit = (F.col("category") == category) & (F.col("status") == "active")
    return sources.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn("prompt_extra", F.when(hit, F.lit(prompt)).otherwise(F.col("prompt_extra")))


def add_rules(rules: DataFrame, added: DataFrame) -> DataFrame:
    """Rules that weren't there get the next numbers, in order; one that is there is left alone. added: rule, seq."""
    new = insert_or_ignore(rules, added, "rule", [F.col("seq")])
    top = rules.agg(F.coalesce(F.max("word_id"), F.lit(0)).alias("top")).first().top
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq"))  # rules typed by hand
    return rules.unionByName(new.select((place + top).cast("bigint").alias("word_id"), "rule", F.lit(None).cast("string").alias("label")))


def label_rules(rules: DataFrame, labels: DataFrame) -> DataFrame:
    """The last label written to each rule, null too. labels: word_id, label, seq."""
    last = labels.groupBy("word_id").agg(F.max_by(F.struct("label"), "seq").alias("new"))
    return rules.join(last, "word_id", "left").withColumn("label", F.when(F.col("new").isNotNull(), F.col("new.label")).otherwise(F.col("label"))).drop("new")


def remove_rules(rules: DataFrame, links: list[DataFrame], gone: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rules without those that go, and every link table without their links. gone: word_id."""
    return rules.join(gone, "word_id", "left_anti"), [t.join(gone, "word_id", "left_anti") for t in links]


def upsert_settings(settings: DataFrame, writes: DataFrame) -> DataFrame:
    """The last value written to a key, else the one that was there. settings: key, value; writes: key, value, seq."""
    last = writes.groupBy("key").agg(F.max_by("value", "seq").alias("new"), F.lit(True).alias("written"))
    out = settings.join(last, "key", "full_outer")
    return out.select("key", F.when(F.coalesce("written", F.lit(False)), F.col("new")).otherwise(F.col("value")).alias("value"))


def append_digest_log(log: DataFrame, sent: DataFrame) -> DataFrame:
    """The log with a row for each digest that went out. sent: sent_at, items_total, status (null: ok)."""
    return log.unionByName(sent.select("sent_at", F.col("items_total").cast("int").alias("items_total"), F.coalesce("status", F.lit("ok")).alias("status")))
