"""Pairs of similar posts. Every join has an equality to hash on: the digest, or the day of a window.

Vectors with their norms are joined within one digest (J10-J12) or one day bucket of the rolling
window (J13), so work grows with what a digest holds, not with the square of the store. A digest or a
day of more than TILE posts is dealt to tiles, and tile meets tile in a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.vectors import cosine, norm
from newsloom.operators.graph import components


#: Posts of a digest or a day that one task compares with as many others.
TILE = 2048


def tiled(rows: DataFrame, key: str) -> DataFrame:
    """rows with tiles, how many their key has, and tile, theirs. rows: id and key."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    return rows.join(sizes, key).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))


def floor_for(category_a: Column, category_b: Column, same: float, cross: float) -> Column:
    """What a pair must clear: more across categories, whose shared words link unrelated posts."""
    other = F.lit("other")
    return F.when(F.coalesce(category_a, other) == F.coalesce(category_b, other), same).otherwise(cross)


def embedded(items: DataFrame, vectors: DataFrame) -> DataFrame:
    return items.join(vectors, "id").withColumn("norm", norm(F.col("v")))


def _side(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows once for each tile they meet: as the left one of a pair of tiles, or the right one."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    left, right = (F.col("tile"), every) if prefix == "a" else (every, F.col("tile"))
    return rows.select("digest", left.alias("left"), right.alias("right"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "source_id", "category", "v", "norm")])


def digest_pairs(rows: DataFrame, same: float, cross: float, within_source: bool = False) -> DataFrame:
    """A < b of one digest, of different sources (or of one), with their cosine. rows: embedded()."""
    rows = tiled(rows, "digest")
    pairs = _side(rows, "a").join(_side(rows, "b"), ["digest", "left", "right"])
    sources = F.col("a_source_id") == F.col("b_source_id")
    pairs = pairs.filter((F.col("a_id") < F.col("b_id")) & (sources if within_source else ~sources))
    score = cosine(F.col("a_v"), F.col("b_v"), F.col("a_norm"), F.col("b_norm"))
    pairs = pairs.withColumn("score", score).filter(F.col("score") >= floor_for(F.col("a_category"), F.col("b_category"), same, cross))
    return pairs.select("digest", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_source_id", "b_source_id", "a_category", "b_category", "score")


def clusters(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Id, component; posts without a pair, or without a vector, are alone."""
    return components(rows.select("id"), pairs.select("a", "b"))


def pool_matches(current: DataFrame, pool: DataFrame, hours: int, same: float, cross: float, near: float) -> DataFrame:
    """Of each current post the best post shown in the window before it, and of its own source
    the best below the near-identical line (a follow-up, never hidden).

    The window is an equality on the day plus a range on the exact time. current, pool: embedded() rows.
    A day's pool is dealt to tiles, each of which the day's posts meet.
    """
    days = hours // 24 + 1
    day = F.floor(F.unix_timestamp("processed_at") / 86400)
    pool = tiled(pool.withColumn("shown_day", day), "shown_day")
    tiles = pool.select(F.explode(F.sequence("shown_day", F.col("shown_day") + days)).alias("day"), "tile").distinct()
    shown = pool.select("tile", F.col("id").alias("sid"), F.col("source_id").alias("s_source"), F.col("category").alias("s_category"), F.col("v").alias("s_v"), F.col("norm").alias("s_norm"), F.col("processed_at").alias("s_at"), F.explode(F.sequence(day, day + days)).alias("day"))
    pairs = current.withColumn("day", day).join(tiles, "day").join(shown, ["day", "tile"]).filter((F.col("s_at") <= F.col("processed_at")) & (F.col("s_at") >= F.col("processed_at") - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("sid") != F.col("id")))
    pairs = pairs.withColumn("score", cosine(F.col("v"), F.col("s_v"), F.col("norm"), F.col("s_norm"))).filter(F.col("score") >= floor_for(F.col("category"), F.col("s_category"), same, cross))
    follow = (F.col("source_id") == F.col("s_source")) & (F.col("score") < near)
    rank = F.struct("score", (-F.col("sid")).alias("k"))
    best = lambda keep, name: F.max_by(F.struct("sid", "score"), F.when(keep, rank)).alias(name)
    out = pairs.groupBy("id").agg(best(~follow, "best"), best(follow, "follow"), F.count_if(~follow).alias("n_best"), F.count_if(follow).alias("n_follow"))
    return out.select("id", F.when(F.col("n_best") > 0, F.col("best.sid")).alias("best_id"), F.when(F.col("n_best") > 0, F.col("best.score")).alias("best_score"),
                      F.when(F.col("n_follow") > 0, F.col("follow.sid")).alias("follow_id"), F.when(F.col("n_follow") > 0, F.col("follow.score")).alias("follow_score"))


def closest_twins(rows: DataFrame, judged: DataFrame, same: float, cross: float) -> DataFrame:
    """Pairs of a post and its closest post of another source in the digest, unless judged before.

    A closest twin that was judged ends the search. judged: a < b.
    """
    return closest_of(digest_pairs(rows, same, cross), judged)


def closest_of(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """closest_twins() among pairs that are known: digest_pairs() of the posts that are left."""
    each = pairs.select("a", "b", "score").union(pairs.select("b", "a", "score"))
    top = each.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b"))).filter("n = 1")
    out = top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct()
    return out.join(judged.select("a", "b"), ["a", "b"], "left_anti")


def usual_length(vectors: DataFrame) -> DataFrame:
    """The vectors of the length that most have; others come from another model."""
    most = vectors.agg(F.mode(F.size("v")).alias("n")).first().n
    return vectors.filter(F.size("v") == F.lit(most))


def fill_vectors(items: DataFrame, vectors: DataFrame, embed, batch: int = 60) -> DataFrame:
    """Vectors, and those of items that have none, from `embed(list of texts) -> list of vectors or None`.

    Batches that fail stay without; nothing is raised. items: id, text.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                try:
                    got = list(embed(list(part["text"])))
                except Exception:  # fail open, whatever the provider does
                    continue
                rows = [(k, [float(x) for x in v]) for k, v in zip(part["id"], got, strict=False) if v is not None]
                yield pd.DataFrame(rows, columns=["id", "v"])

    missing = items.filter(F.trim(F.coalesce("text", F.lit(""))) != "").join(vectors.select("id"), "id", "left_anti")
    return vectors.select("id", "v").unionByName(missing.select("id", "text").mapInPandas(run, "id long, v array<float>"))
