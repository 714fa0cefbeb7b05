"""Signatures and exact reposts: what a source says again in the same words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators.graph import cut


def _above_and_last(lines: DataFrame) -> DataFrame:
    last = F.element_at("lines", -1)
    return lines.filter(F.size("lines") > 1).select("source_id", last.alias("line"), F.md5(F.array_join(F.slice("lines", 1, F.size("lines") - 1), "\n")).alias("body"))


def with_lines(posts: DataFrame) -> DataFrame:
    """posts with the `lines` of their texts, and `context`: whether the first of them quotes the answered post. posts: raw_text."""
    context = F.coalesce("raw_text", F.lit("")).rlike(text.CONTEXT)
    return posts.withColumn("lines", text.text_lines(F.col("raw_text"))).withColumn("context", context)


def footer_round(lines: DataFrame, least: int = 5) -> DataFrame:
    """Last lines that sign at least that many different bodies, in half of their posts. lines: source_id, lines."""
    return _signing(_above_and_last(lines), least)


def _signing(ends: DataFrame, least: int) -> DataFrame:
    per = ends.groupBy("source_id", "line").agg(F.countDistinct("body").alias("bodies"), F.count(F.lit(1)).alias("posts"))
    return per.filter((F.col("bodies") >= least) & (F.col("bodies") * 2 >= F.col("posts"))).select("source_id", "line")


def strip_known(lines: DataFrame, footers: DataFrame) -> DataFrame:
    """Trailing signature lines off, never the only line. lines: id, source_id, lines."""
    known = footers.groupBy("source_id").agg(F.collect_set("line").alias("known"))
    rows = lines.join(known, "source_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    keep = F.aggregate(
        F.reverse("lines"), F.struct(F.lit(0).alias("cut"), F.lit(True).alias("at_end")),
        lambda s, x: F.struct((s["cut"] + F.when(s["at_end"] & F.array_contains("known", x), 1).otherwise(0)).alias("cut"), (s["at_end"] & F.array_contains("known", x)).alias("at_end")),
        lambda s: F.greatest(F.size("lines") - s["cut"], F.least(F.size("lines"), F.lit(1))),
    )
    return rows.withColumn("keep", keep).withColumn("lines", F.slice("lines", 1, F.greatest("keep", F.lit(0)))).drop("keep", "known")


def footers(posts: DataFrame, least: int = 5, rounds: int = 3) -> DataFrame:
    """source_id, line. posts: id, source_id, and raw_text or with_lines(). Inner lines of a signature show once the outer are gone.

    A round takes apart only the posts that end with a signature; what the others end with was found by the first.
    """
    lines = posts.select("id", "source_id", "lines") if "lines" in posts.columns else cut(with_lines(posts).select("id", "source_id", "lines"))
    ends = cut(_above_and_last(lines))
    found = cut(_signing(ends, least))
    for _ in range(rounds - 1):
        known = found.select(F.col("source_id").alias("_source"), F.col("line").alias("_line"))
        signed = lines.join(known, (F.col("source_id") == F.col("_source")) & (F.try_element_at("lines", F.lit(-1)) == F.col("_line")), "left_semi")
        now = ends.join(found, ["source_id", "line"], "left_anti").unionByName(_above_and_last(strip_known(signed, found)))
        more = cut(_signing(now, least).join(found, ["source_id", "line"], "left_anti"))
        if more.isEmpty():
            break
        found = cut(found.unionByName(more))
    return found


def with_keys(posts: DataFrame, signatures: DataFrame | None, least: int = 100) -> DataFrame:
    """posts plus `key`, the text that tells a repost, without signatures. posts: raw_text or with_lines(), whose columns go."""
    if signatures is None:
        return posts.withColumn("key", text.repost_key(F.col("raw_text"), least))
    lines = posts if "lines" in posts.columns else with_lines(posts)
    own = F.when(F.col("context"), F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))
    return strip_known(lines.withColumn("lines", own), signatures).withColumn("key", text.repost_key(F.array_join("lines", "\n"), least)).drop("lines", "context")


def looked_back(pool: DataFrame, digests: DataFrame, hours: int) -> DataFrame:
    """id, digest: posts shown at most that long before a digest went out, and not after it. pool: id, processed_at; digests: digest, as_of.

    A digest looks for its days by equality, so work grows with what the windows hold.
    """
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400)
    windows = digests.select("digest", "as_of", F.explode(F.sequence(day("as_of") - F.lit(-(-hours // 24)), day("as_of"))).alias("day"))
    seen = pool.select("id", "processed_at", day("processed_at").alias("day")).join(windows, "day")
    return seen.filter((F.col("processed_at") <= F.col("as_of")) & (F.col("processed_at") > F.col("as_of") - F.make_dt_interval(F.lit(0), F.lit(hours)))).select("id", "digest")


def exact_reposts(posts: DataFrame, most: int = 2, within: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Id, earlier_id. posts: id, source_id, key, moment, hidden, pool (shown before), and the columns of `within`.

    A text told more often than that is a template, each time new. Hidden posts count, but are never
    the earlier post. Texts are compared within equal columns of `within`; of a digest with what it looks
    back on, these are its number and the source, and the pool what looked_back() gives for it.
    """
    group = [*within, "slot"]
    slot = cut(posts.filter("key <> ''").select("id", *within, F.md5("key").alias("slot"), "moment", "hidden", "pool"))
    few = slot.groupBy(*group).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times").between(2, most))
    told = slot.join(few, group)  # `most` rows of a text at most are ever sorted
    order = Window.partitionBy(*group).orderBy((~F.col("pool")).cast("int"), F.col("moment").asc_nulls_first(), "id")
    shown = F.when(~F.col("hidden"), F.col("id"))
    earlier = F.first(shown, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return told.withColumn("earlier_id", earlier).filter("NOT pool AND earlier_id IS NOT NULL").select("id", "earlier_id")


def recurring(posts: DataFrame) -> DataFrame:
    """How often each text of a source recurs. posts: id, source_id, key."""
    return posts.filter("key <> ''").groupBy("source_id", F.md5("key").alias("slot")).agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("first_id")).filter("times > 1")


def tally_nights(posts: DataFrame, pattern: str = text.TALLY, hours: int = 10) -> DataFrame:
    """Neighbouring tallies of a source that are two nights. posts: id, source_id, raw_text, moment."""
    tallies = posts.filter(F.col("raw_text").rlike(pattern))
    w = Window.partitionBy("source_id").orderBy("moment", "id")
    apart = F.abs(F.unix_timestamp("moment") - F.unix_timestamp(F.lag("moment").over(w))) / 3600
    return tallies.withColumn("earlier_id", F.lag("id").over(w)).withColumn("apart", F.coalesce(apart, F.lit(0.0))).filter(F.col("earlier_id").isNotNull() & (F.col("apart") >= hours)).select("id", "earlier_id")
