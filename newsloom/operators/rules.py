"""Content rules: literal ones run here, judged ones through a provider whose answers are checked."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import APOSTROPHES, DASHES, is_media_only, normal_for_rules, wants, NO_FILTER
from newsloom.operators.phrases import first_hits

LITERAL = "="
#: Literal rules up to which they are one expression of nested tests; more are looked for by an automaton.
NESTED = 32
BLOCK_AT = 8
CHUNK = 10


def _normal(rule: str) -> str:
    from newsloom.functions.text import FILLERS, ZERO_WIDTH

    return " ".join(re.sub(ZERO_WIDTH, "", re.sub(FILLERS, " ", rule)).split()).casefold()


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", text)


def literal_pattern(rule: str) -> str | None:
    """A Java pattern over normalised text. Runs of dashes, apostrophes and white space are interchangeable;
    a rule of dashes alone is taken as it is; an empty rule matches nothing."""
    text = _normal(rule)
    if not text:
        return None
    dash = "[" + _quoted(DASHES) + "]"
    if not re.sub(rf"[\s{re.escape(DASHES)}]", "", text):
        return _quoted(text)
    out, i = [], 0
    while i < len(text):
        run = re.match(rf"\s*[{re.escape(DASHES)}][\s{re.escape(DASHES)}]*", text[i:])
        if run:
            out.append(rf"\s*+{dash}++(?:\s*+{dash}++)*+\s*+")
            i += run.end()
        elif text[i] in APOSTROPHES:
            out.append(f"[{APOSTROPHES}]")
            i += 1
        elif text[i].isspace():
            out.append(r"\s+")
            i += 1
        else:
            out.append(_quoted(text[i]))
            i += 1
    return "".join(out)


def scoped(rules: DataFrame, rule_categories: DataFrame, rule_sources: DataFrame) -> DataFrame:
    """Rules with the categories and sources they are limited to; an empty list limits nothing."""
    c = rule_categories.groupBy("word_id").agg(F.collect_set("category").alias("categories"))
    s = rule_sources.groupBy("word_id").agg(F.collect_set("source_id").alias("source_ids"))
    out = rules.join(c, "word_id", "left").join(s, "word_id", "left")
    return out.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))).withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<bigint>")))


def in_scope(category: Column, source_id: Column, categories: list[str], source_ids: list[int]) -> Column:
    """P13."""
    out = F.lit(True)
    if categories:
        out = out & F.coalesce(category, F.lit("other")).isin(sorted(categories))
    if source_ids:
        out = out & F.coalesce(source_id.isin(sorted(source_ids)), F.lit(False))
    return out


def literal_hits(items: DataFrame, rules: DataFrame, nested: int = NESTED) -> DataFrame:
    """Items plus `hit`, the first literal rule (by word_id) that matches in its scope, or null.

    Up to `nested` rules become one expression over a single scan of the items, inside the JVM; of more,
    a text would be searched once for each, so they become an automaton (phrases.first_hits). Both find the same.
    """
    few = rules.filter(F.trim("rule").startswith(LITERAL)).orderBy("word_id").limit(nested + 1).collect()
    if len(few) > nested:
        return first_hits(items, rules, LITERAL)
    rows = items.withColumn("_text", normal_for_rules(F.col("raw_text")))
    hit = F.lit(None).cast("string")
    for r in reversed(few):
        pattern = literal_pattern(r.rule.strip()[len(LITERAL) :])
        if pattern is not None:
            hit = F.when(F.col("_text").rlike(pattern) & in_scope(F.col("category"), F.col("source_id"), r.categories, r.source_ids), r.rule).otherwise(hit)
    return rows.withColumn("hit", hit).drop("_text")


def chunked(items: DataFrame, size: int = CHUNK) -> DataFrame:
    """Items dealt into the chunks a provider is asked about, within their digest."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("digest").orderBy("category", "id")) - 1
    return items.withColumn("chunk", F.floor(place / size))


def shown_rules(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """digest, chunk, word_id: the judged rules that a chunk's posts can fall under at all."""
    judged = rules.filter(~F.trim("rule").startswith(LITERAL)).select("word_id", "categories", "source_ids").collect()  # a short hand-written list
    seen = chunks.groupBy("digest", "chunk").agg(F.collect_set(F.coalesce("category", F.lit("other"))).alias("cats"), F.collect_set("source_id").alias("srcs"))

    def fits(r) -> Column:
        inside = lambda column, some: F.arrays_overlap(column, F.array(*map(F.lit, some))) if some else F.lit(True)
        return inside("cats", r.categories) & inside("srcs", r.source_ids)

    shown = F.array_compact(F.array(*[F.when(fits(r), F.lit(r.word_id)) for r in judged])) if judged else F.array().cast("array<bigint>")
    return seen.select("digest", "chunk", F.explode(shown).alias("word_id"))


def valid_blocks(chunks: DataFrame, rules: DataFrame, answers: DataFrame) -> DataFrame:
    """Id, rule: answers that count. answers: digest, chunk, id, word_id, confidence (null: 10).

    An answer counts for a post and a rule that its chunk carried, in the rule's scope, from BLOCK_AT on.
    """
    sure = answers.filter(F.coalesce("confidence", F.lit(10)) >= BLOCK_AT)
    rows = sure.join(shown_rules(chunks, rules), ["digest", "chunk", "word_id"], "left_semi")
    rows = rows.join(chunks.select("digest", "chunk", "id", "category", "source_id"), ["digest", "chunk", "id"]).join(rules, "word_id")
    fits = ((F.size("categories") == 0) | F.array_contains("categories", F.coalesce("category", F.lit("other")))) & ((F.size("source_ids") == 0) | F.array_contains("source_ids", F.col("source_id")))
    return rows.filter(fits).groupBy("id").agg(F.min_by("rule", "word_id").alias("rule"))


def filterable(queue: DataFrame) -> DataFrame:
    """Posts a filter may judge: with text, of a source that didn't opt out."""
    return queue.withColumn("filterable", ~is_media_only(F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("raw_text"))) & ~wants(F.col("source_prompt_extra"), NO_FILTER))


def normalise_groups(items: DataFrame, groups: DataFrame) -> DataFrame:
    """A grouping that covers exactly the posts asked about. groups: digest, group_no, ids.

    Unknown posts drop out, a post named twice stays in its first group, empty groups vanish, posts left out are alone.
    """
    named = groups.select("digest", "group_no", F.explode("ids").alias("id")).join(items.select("digest", "id"), ["digest", "id"], "left_semi")
    first = named.groupBy("digest", "id").agg(F.min("group_no").alias("group_no"))
    alone = items.select("digest", "id").join(first, ["digest", "id"], "left_anti").select("digest", "id", (-F.col("id") - 1).alias("group_no"))
    return first.unionByName(alone).groupBy("digest", "group_no").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def route(items: DataFrame, answers: DataFrame, targets: list[str]) -> DataFrame:
    """Waiting posts move to the category an answer names, if it is one of the targets. answers: id, category."""
    good = answers.filter(F.col("category").isin(targets)).groupBy("id").agg(F.min("category").alias("target"))
    return items.join(good, "id", "left").withColumn("category", F.when(~F.col("sent"), F.coalesce("target", "category")).otherwise(F.col("category"))).drop("target")


def folded_reports(items: DataFrame, answers: DataFrame, as_of: Column, least: int = 3, most_hours: int = 18) -> DataFrame:
    """Id, place: reports folded into one block, its overview first, the rest by time.

    answers: digest, chunk, id, overview. The last chunk's overview wins; fewer than `least` posts are not folded.
    """
    from pyspark.sql import Window

    young = items.filter(F.unix_timestamp(as_of) - F.unix_timestamp("published_at") <= most_hours * 3600)
    rows = young.join(answers.groupBy("digest", "id").agg(F.max(F.when(F.col("overview"), F.col("chunk"))).alias("overview_chunk")), ["digest", "id"])
    whole = Window.partitionBy("digest")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("top", F.max(F.struct("overview_chunk", (-F.col("id")).alias("k"))).over(whole)).filter(F.col("n") >= least)
    lead = F.col("overview_chunk").isNotNull() & (F.col("top.k") == -F.col("id"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy(lead.desc(), "published_at", "id"))).select("digest", "id", "place")
