"""The digest as a whole, from the decisions of all passes to messages.

Every pass is a table of decisions about posts (deferred, blocked, hidden, updates, folded, answered),
so a pass that failed is a table with fewer rows and the digest goes out with what there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import clock
from newsloom.functions.plain import reply_quote_column, rule_title
from newsloom.functions.text import source_link
from newsloom.operators import digest, merge, render
from newsloom.operators.graph import cut

# Titles of the blocks that are no source's.
WAR_NIGHT, WAR_DAY = "🌙 War overnight", "⚔️ War"
FILTERED = "\n<b>🚫 🚫 🚫 Filtered</b>"
LITERAL = "= exact phrases"
#: Places after all categories and sources.
LAST = 1_000_000

ROW = "digest long, section_place int, section string, block_place int, block string, line_place int, html string, ids array<long>"


def merged(shown: DataFrame, clusters: DataFrame, updates: DataFrame, store: DataFrame) -> DataFrame:
    """A row of each line: its posts' ids, newest summary and address, earlier posts; an update links the post it goes on.

    shown: posts of digests with source_name, source_sort_order; clusters: id, component; updates: id, shown_id; store: id, original_url, published_at.
    """
    rows = shown.join(clusters, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lines = merge.merged_lines(rows.select("component", "id", "summary", "original_url", "published_at"))
    before = store.select(F.col("id").alias("shown_id"), F.struct(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.col("original_url").alias("url")).alias("told"))
    linked = updates.join(before.filter("told.moment IS NOT NULL AND told.url IS NOT NULL"), "shown_id").join(rows.select("id", "component"), "id").groupBy("component").agg(F.collect_set("told").alias("told"))
    lines = lines.join(linked, "component", "left").withColumn("earlier", F.array_sort(F.array_union("earlier", F.coalesce("told", F.filter("earlier", lambda _: F.lit(False))))))
    place = rows.groupBy("component").agg(F.min_by(F.struct("id", "digest", "category", "source_id", "source_name", "source_sort_order", "published_at", "processed_at"), "id").alias("first"))
    return merge.earlier_links(lines.drop("told")).join(place, "component").select("component", "item_ids", "summary", F.col("url").alias("original_url"), "moment", F.col("shown").alias("earlier"), "more", "first.*")


def told_elsewhere(lines: DataFrame, hidden: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Component, links: name and address of the sources whose copies are hidden under a line's posts, each once."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name"), "sort_order")
    copies = hidden.join(items.select("id", "source_id", F.col("original_url").alias("url")), "id").join(s, "source_id").select(F.col("primary_id").alias("post"), "id", "name", "url", "sort_order", "source_id")
    own = lines.select("component", F.col("source_id").alias("own"), F.explode("item_ids").alias("post"))
    rows = copies.join(own, "post").filter("source_id <> own AND url IS NOT NULL")
    first = rows.groupBy("component", "name").agg(F.min(F.struct("sort_order", "id", "name", "url")).alias("l"))
    return first.groupBy("component").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url"))).alias("links"))


def threaded(lines: DataFrame, parents: DataFrame, store: DataFrame, as_of: Column, zone: str = clock.ZONE) -> DataFrame:
    """Lines with line_place, nested, and the post a reply that doesn't stand beside it answers (reply).

    parents: id, parent_id, shown_as (digest.reply_parents); store: id, summary, raw_text, original_url, published_at, source_name.
    """
    order = Window.partitionBy("digest", "category", "source_name").orderBy(F.col("published_at").asc_nulls_first(), "id")
    rows = lines.join(parents.groupBy("id").agg(F.min("parent_id").alias("parent_id"), F.min("shown_as").alias("shown_as")), "id", "left").withColumn("position", F.row_number().over(order))
    group = F.xxhash64("digest", "category", "source_name")
    places = cut(digest.threads(rows.select(group.alias("digest"), "id", "position", F.col("parent_id").alias("parent"))).select(F.col("id"), F.col("place").alias("line_place"), "nested"))
    other = F.coalesce("shown_as", "parent_id")
    s = store.select(F.col("id").alias("answered"), F.struct(clock.day_label(F.col("published_at"), as_of, zone).alias("at"), F.col("original_url").alias("url"), reply_quote_column(F.col("summary"), F.col("raw_text")).alias("quote"), F.col("source_name").alias("name")).alias("a"))
    out = rows.join(places, "id").join(s, other == F.col("answered"), "left")
    what = F.when(F.col("shown_as").isNotNull(), F.col("a.name")).otherwise(F.col("a.quote"))
    return out.withColumn("reply", F.when(~F.col("nested") & F.col("a").isNotNull(), F.struct(F.coalesce("a.at", F.lit("→")).alias("at"), F.col("a.url").alias("url"), what.alias("what")))).drop("answered", "a", "parent_id", "shown_as", "position")


def _html(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        html = []
        for r in f.to_dict("records"):
            links = [(x["name"], x["url"]) for x in (r["links"] if r["links"] is not None else [])]
            earlier = [(x["at"], x["url"]) for x in (r["earlier"] if r["earlier"] is not None else [])]
            reply = tuple(r["reply"][k] for k in ("at", "url", "what")) if r["reply"] is not None else None
            html.append(render.post_line({"summary": r["summary"], "url": r["original_url"], "at": r["at"], "nested": r["nested"], "via": r["via"], "links": links, "earlier": earlier, "more": r["more"], "reply": reply}))
        f["html"] = html
        yield f[[c.split()[0] for c in ROW.split(", ")]]


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# The head of the block, and what keeps a client from taking a name for a domain.
QUIET = "<b>💤 Quiet sources</b> (5+ days without new items)"
JOINER = "\u2060"


def silent_block(silent: DataFrame) -> DataFrame:
    """Text: the block of a digest that lists quiet sources, the longest silence first; empty without any.

    silent: id, name, type, url, last_item_at, hours_silent (analytics.silent). A line is a source.
    """
    name = F.regexp_replace(F.replace(F.replace(_escaped(F.col("name")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")), r"(?U)(?<=\w)\.(?=\w)", "." + JOINER)
    link = source_link(F.col("type"), F.col("url"))
    href = F.replace(F.replace(_escaped(link), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    label = F.when(link.isNotNull(), F.concat(F.lit('<a href="'), href, F.lit('">'), name, F.lit("</a>"))).otherwise(name)
    age = F.coalesce(F.concat(F.floor(F.col("hours_silent") / 24).cast("string"), F.lit("d")), F.lit("never"))
    line = F.struct(F.col("last_item_at").isNotNull().alias("known"), "last_item_at", "id", F.concat(F.lit("• "), label, F.lit(" — "), age).alias("line"))
    told = silent.agg(F.array_sort(F.collect_list(line)).alias("lines"))
    body = F.concat(F.lit(f"<blockquote expandable>{QUIET}\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("</blockquote>"))
    return told.select(F.when(F.size("lines") > 0, body).otherwise("").alias("text"))


def rows(lines: DataFrame, links: DataFrame, folded: DataFrame, blocked: DataFrame, categories: DataFrame, as_of: Column, morning: Column, zone: str = clock.ZONE) -> DataFrame:
    """What render.messages packs: the lines of categories and sources, war blocks, the filtered section.

    lines: threaded(); folded: digest, id, place; blocked: digest, id, rule, title, summary, original_url, published_at; categories: name, emoji, place.
    """
    places = categories.select(F.col("name").alias("category"), "emoji", F.col("place").cast("int").alias("section_place"))
    full = lines.join(links, "component", "left").join(places, "category", "left").join(folded.select("digest", "id", F.col("place").alias("war")), ["digest", "id"], "left")
    many = F.sum(F.when(F.col("war").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("digest", "category"))
    title = F.concat(F.when(morning, WAR_NIGHT).otherwise(WAR_DAY), F.lit(" · "), many)
    name = F.coalesce("source_name", F.lit("Unknown"))
    heading = F.concat(F.lit(f"\n<b>{render.RULE}</b>\n<b>"), F.coalesce("emoji", F.lit("📌")), F.lit("  "), _escaped(F.array_join(F.split(F.upper("category"), ""), " ")), F.lit("</b>"))
    war = F.col("war").isNotNull()
    label = lambda p: F.struct(F.coalesce(clock.day_label(F.try_to_timestamp(p["moment"]), as_of, zone), F.lit("→")).alias("at"), p["url"].alias("url"))
    told = full.select(
        "digest", F.coalesce("section_place", F.lit(LAST - 1)).alias("section_place"), heading.alias("section"),
        F.when(war, 0).otherwise(F.coalesce("source_sort_order", F.lit(LAST)) + 1).cast("int").alias("block_place"), F.when(war, title).otherwise(name).alias("block"),
        F.coalesce("war", "line_place").cast("int").alias("line_place"), F.col("item_ids").alias("ids"),
        "summary", "original_url", clock.day_label(F.try_to_timestamp("moment"), as_of, zone).alias("at"), (F.col("nested") & ~war).alias("nested"), F.when(war, name).alias("via"), "links", F.transform("earlier", label).alias("earlier"), "more", "reply",
    )
    literal = F.ltrim(F.col("rule")).startswith("=")
    key = F.when(literal, LITERAL).otherwise(F.col("rule"))
    n = F.count(F.lit(1)).over(Window.partitionBy("digest", key))
    gone = blocked.withColumn("key", key).withColumn("n", n).withColumn("literal", literal)
    listed = gone.filter("NOT literal").select(
        "digest", F.lit(LAST).alias("section_place"), F.lit(FILTERED).alias("section"), F.lit(0).alias("block_place"), F.concat("title", F.lit(" · "), "n").alias("block"),
        F.row_number().over(Window.partitionBy("digest", "key").orderBy("id")).alias("line_place"), F.array().cast("array<long>").alias("ids"),
        "summary", "original_url", clock.day_label(F.col("published_at"), as_of, zone).alias("at"), F.lit(False).alias("nested"), F.lit(None).cast("string").alias("via"),
        F.lit(None).cast(told.schema["links"].dataType).alias("links"), F.lit(None).cast(told.schema["earlier"].dataType).alias("earlier"), F.lit(0).alias("more"), F.lit(None).cast(told.schema["reply"].dataType).alias("reply"),
    )
    counted = gone.filter("literal").groupBy("digest").agg(F.max("n").alias("n")).select(
        "digest", F.lit(LAST).alias("section_place"), F.lit(FILTERED).alias("section"), F.lit(1).alias("block_place"), F.concat(F.lit(f"{LITERAL} · "), "n").alias("block"), F.lit(1).alias("line_place"), F.lit("").alias("html"), F.array().cast("array<long>").alias("ids"),
    )
    return told.unionByName(listed).mapInPandas(_html, ROW).unionByName(counted)


def titles(rule: Column) -> Column:
    """What a judged rule's block is called without a label: its first clause."""

    @F.arrow_udf("string")
    def run(rules: pa.Array) -> pa.Array:
        return pa.array([rule_title(r) if r is not None else "?" for r in rules.to_pylist()], pa.string())

    return run(rule)


def messages(told: DataFrame, issues: DataFrame) -> DataFrame:
    """D32 for every digest. issues: digest, issue, items, title."""
    return render.messages(told.join(issues, "digest"))
