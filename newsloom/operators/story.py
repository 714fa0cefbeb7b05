"""Hiding copies of stories, from reposts to survivors, for every digest at once.

Composed of the steps in reposts, similarity and dedup; each is a table of decisions, so one that a
judge leaves open simply has fewer rows. Thresholds are those of the embedding model in use.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import dedup, reposts, similarity
from newsloom.operators.graph import cut
from newsloom.operators.judge import Judge


@dataclass(frozen=True)
class Lines:
    """Cosines a pair must reach."""

    same: float = 0.86
    cross: float = 0.90
    hide_in_digest: float = 0.90
    hide: float = 0.94
    repeat: float = 0.95
    near: float = 0.975
    twin: float = 0.88
    hours: int = 48


def settle(pairs: DataFrame) -> DataFrame:
    """Id, primary_id: twins hidden, the most similar first; one hide of a post, none under or of a
    post that this pass hid or hid under. pairs: digest, id, primary_id, score; a digest is a group."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        hidden: dict[int, int] = {}
        over: set[int] = set()
        for r in frame.sort_values(["score", "id", "primary_id"], ascending=False).itertuples():
            if r.id not in hidden and r.primary_id not in hidden and r.id not in over:
                hidden[r.id] = r.primary_id
                over.add(r.primary_id)
        return pd.DataFrame({"id": list(hidden), "primary_id": list(hidden.values())}, dtype="int64")

    return pairs.groupBy("digest").applyInPandas(fold, "id long, primary_id long")


def deduplicate(items: DataFrame, pool: DataFrame, vectors: DataFrame, judge: Judge, lines: Lines = Lines()) -> tuple[DataFrame, DataFrame]:
    """(hidden, updates): id, primary_id of posts hidden under a survivor; id, shown_id of posts that go on a shown story.

    items: posts of digests with their source's columns (queue.with_source); pool: posts that were shown, of
    which a digest sees those of the `hours` before it went out, and each post those of the `hours` before it.
    """
    items = cut(_told(items))
    own_digest = cut(items.select("id", "digest"))
    digests = cut(items.groupBy("digest").agg(F.min("processed_at").alias("begin"), F.max("processed_at").alias("as_of")))
    seen = pool.filter(~text.is_placeholder(F.col("summary"))).join(own_digest.select("id"), "id", "left_anti")
    pool = cut(_told(_in_reach(seen, digests, lines.hours)))
    before = cut(reposts.looked_back(pool, digests, lines.hours))

    # 1. a source's own words again
    columns = ["id", "source_id", "lines", "context", F.col("published_at").alias("moment")]
    recent = pool.join(before.select("id").distinct(), "id", "left_semi").select(*columns, F.col("duplicate_of").isNotNull().alias("hidden"), F.lit(True).alias("pool"))
    both = items.select(*columns, F.lit(False).alias("hidden"), F.lit(False).alias("pool")).unionByName(recent)
    keyed = cut(reposts.with_keys(both, reposts.footers(both)).withColumn("key", F.md5("key")))  # no text goes through the join
    keyed = keyed.withColumn("key", F.nullif("key", F.md5(F.lit("")))).join(own_digest.unionByName(before), "id")
    repeated = cut(reposts.exact_reposts(keyed, within=("digest", "source_id")).select("id", F.col("earlier_id").alias("primary_id")))

    # 2. all but identical across sources: no judge
    embedded = cut(similarity.embedded(items.filter(~text.is_placeholder(F.col("summary"))), vectors))
    close = cut(similarity.digest_pairs(embedded, lines.same, lines.cross))
    near = cut(dedup.candidates(_grouped(items, close.filter(F.col("score") >= lines.near))))
    settled = repeated.unionByName(near)

    # 3. candidates: the best shown post, else the best of the digest's group
    rest = embedded.join(settled.select("id"), "id", "left_anti")
    shown = similarity.embedded(pool, vectors)
    matches = cut(similarity.pool_matches(rest, shown, lines.hours, lines.same, lines.cross, lines.near))
    best = matches.filter("best_id IS NOT NULL").select("id", F.col("best_id").alias("primary_id"), F.col("best_score").alias("score"))
    live = close.join(settled.select(F.col("id").alias("a")), "a", "left_anti").join(settled.select(F.col("id").alias("b")), "b", "left_anti")
    groups = _grouped(items, live).join(best.select("id", F.lit(True).alias("has_shown")), "id", "left")
    own = _primaries(groups)
    scores = close.select("a", "b", "score").union(close.select("b", "a", "score"))
    first = own.join(best, "id", "left_anti")
    asked = _asked(best, items, pool, True).unionByName(_asked(_scored(first, scores), items, items, False))
    outcome = cut(dedup.confirm(asked, judge, lines.hide_in_digest, lines.hide, lines.repeat))
    hidden = outcome.filter("outcome = 'hidden'").select("id", "primary_id")

    # 4. a shown match refused: the digest's own group gets its say; refused ones may be one story among themselves
    retry = own.join(best, "id", "left_semi").join(hidden.select("id"), "id", "left_anti").join(hidden.select(F.col("id").alias("primary_id")), "primary_id", "left_anti")
    second = cut(dedup.confirm(_asked(_scored(retry, scores), items, items, False), judge, lines.hide_in_digest, lines.hide, lines.repeat))
    refused = outcome.unionByName(second).filter("outcome <> 'hidden'").select("id", "primary_id")
    again = cut(dedup.regroup(refused, items, close, lines.same).withColumnRenamed("survivor_id", "primary_id"))
    third = cut(dedup.confirm(_asked(_scored(again, scores), items, items, False), judge, 2.0, 2.0, 2.0))
    hide = lambda table: table.filter("outcome = 'hidden'").select("id", "primary_id")
    hidden = cut(_first_said(repeated, near, hidden, hide(second), hide(third)))

    # 5. closest twins that nobody put to the judge together
    seen = outcome.select("id", "primary_id").unionByName(second.select("id", "primary_id")).unionByName(again.select("id", "primary_id")).unionByName(settled)
    judged = seen.select(F.least("id", "primary_id").alias("a"), F.greatest("id", "primary_id").alias("b")).distinct()
    alive = close.join(hidden.select(F.col("id").alias("a")), "a", "left_anti").join(hidden.select(F.col("id").alias("b")), "b", "left_anti")
    twins = similarity.closest_of(alive, judged).filter(F.col("score") >= lines.twin)
    order = items.select("id", "digest", dedup.rank_key().alias("rank"))
    twins = twins.join(order.toDF("a", "digest", "ra"), "a").join(order.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    twins = twins.select("digest", F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("id"), F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("primary_id"), "score")
    verdict = cut(dedup.confirm(_asked(twins.drop("digest"), items, items, False), judge, 2.0, 2.0, 2.0))
    agreed = verdict.join(twins.select("digest", "id", "primary_id", "score"), ["id", "primary_id"]).filter((F.col("outcome") == "hidden") & ((F.col("verdict") == "same") | (F.col("score") >= lines.hide_in_digest)))
    hidden = cut(hidden.unionByName(settle(agreed.select("digest", "id", "primary_id", "score"))))

    # 6. follow-ups of a source's own shown story, and where every hidden post finally stands
    follow = matches.filter("follow_id IS NOT NULL").select("id", F.col("follow_id").alias("shown_id")).join(hidden.select("id"), "id", "left_anti")
    said = judge.pairs(follow.select(F.col("shown_id").alias("a"), F.col("id").alias("b"))).filter("verdict IN ('same', 'update')").select(F.col("b").alias("id"), F.col("a").alias("shown_id"))
    updates = cut(_first_said(outcome.filter("outcome = 'update'").select("id", F.col("primary_id").alias("shown_id")), said))
    final = cut(dedup.survivors(hidden))
    handed = updates.join(final, "id").select(F.col("primary_id").alias("id"), "shown_id").join(updates.select("id"), "id", "left_anti")
    return final, updates.unionByName(_first_said(handed)).join(final.select("id"), "id", "left_anti")


def _told(posts: DataFrame) -> DataFrame:
    """posts with what their texts tell, taken from each text once; of the text itself its lines stay."""
    return reposts.with_lines(dedup.with_richness(posts).withColumn("tally", text.is_tally(F.col("raw_text")))).drop("raw_text")


def _in_reach(pool: DataFrame, digests: DataFrame, hours: int) -> DataFrame:
    """What any digest, or any of its posts, looks back on; texts of other days are not read on."""
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400)
    days = digests.select(F.explode(F.sequence(day(F.least("begin", "as_of")) - F.lit(-(-hours // 24)), day("as_of"))).alias("_day")).distinct()
    return pool.withColumn("_day", day("processed_at")).join(days, "_day", "left_semi").drop("_day")


def _first_said(*decisions: DataFrame) -> DataFrame:
    """One decision of each post: of the first table that has one, the least other post. decisions: id, and another post."""
    other = decisions[0].columns[1]
    rows = reduce(DataFrame.unionByName, [t.withColumn("step", F.lit(k)) for k, t in enumerate(decisions)])
    return rows.groupBy("id").agg(F.min(F.struct("step", other)).alias("first")).select("id", F.col(f"first.{other}").alias(other))


def _grouped(items: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return items.join(similarity.clusters(ends, pairs), "id")


def _primaries(groups: DataFrame) -> DataFrame:
    """As dedup.candidates, with a post that has no shown match first in line to stay."""
    key = F.struct(F.coalesce("has_shown", F.lit(False)).alias("h"), dedup.rank_key().alias("k"))
    best = groups.groupBy("component").agg(F.min_by(F.struct("id", "source_id"), key).alias("p"))
    rows = groups.select("id", "source_id", "component").join(best, "component")
    return rows.filter((F.col("id") != F.col("p.id")) & (F.col("source_id") != F.col("p.source_id"))).select("id", F.col("p.id").alias("primary_id"))


def _scored(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    return pairs.select("id", "primary_id").join(scores.toDF("id", "primary_id", "score"), ["id", "primary_id"], "left")


def _asked(pairs: DataFrame, items: DataFrame, primaries: DataFrame, shown: bool) -> DataFrame:
    """What dedup.confirm wants to know of each pair."""
    mine = items.select("id", "category", "richness", "published_at", "tally")
    theirs = primaries.select(F.col("id").alias("primary_id"), F.col("category").alias("p_category"), F.col("richness").alias("primary_richness"), F.col("published_at").alias("p_at"), F.col("tally").alias("p_tally"))
    rows = pairs.join(mine, "id").join(theirs, "primary_id")
    apart = F.abs(F.unix_timestamp("published_at") - F.unix_timestamp("p_at")) / 3600
    night = F.col("tally") & F.col("p_tally") & (F.coalesce(apart, F.lit(0.0)) >= 10)
    other: Column = F.lit("other")
    return rows.select("id", "primary_id", F.col("score").cast("double").alias("score"), F.lit(shown).alias("shown"), (F.coalesce("category", other) == F.coalesce("p_category", other)).alias("same_category"), "richness", "primary_richness", night.alias("other_night"))
