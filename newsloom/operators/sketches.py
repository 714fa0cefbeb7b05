"""The views baseline from sketches: a row of each source and day, written once and merged over the days asked for.

A KLL sketch of K tells a quantile of the values it has seen within a rank error of about RANK_ERROR of
their number (99 % confidence), however often sketches are merged; up to K values are kept as they are. A new
day adds its own rows, so a baseline reads a small row of each source and day and no posts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = 400
#: Of one rank that is asked for, at K.
RANK_ERROR = 0.007
SCHEMA = "source_id BIGINT, sketch BINARY, day DATE"


def counted(posts: DataFrame) -> DataFrame:
    """What tells the usual views: posts that went out, no copies, nothing blocked."""
    return posts.filter(F.col("views").isNotNull() & F.col("sent") & F.col("duplicate_of").isNull() & F.col("blocked_reason").isNull() & F.col("published_at").isNotNull())


def add_days(posts: DataFrame, path: str) -> None:
    """Sketches of the days of these posts, each instead of what the day had. posts: source_id, views, published_at, and the columns of counted()."""
    rows = counted(posts).groupBy(F.col("published_at").cast("date").alias("day"), "source_id").agg(F.kll_sketch_agg_bigint(F.col("views").cast("bigint"), F.lit(K)).alias("sketch"))
    # a day is one file, not one of each task, and all cores write: what a day costs is its file
    tasks = 4 * posts.sparkSession.sparkContext.defaultParallelism
    rows.repartition(tasks, "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def baseline(spark: SparkSession, path: str, last: dt.date, days: int = 7, least: int = 10) -> DataFrame:
    """source_id, usual, posts over the days up to `last`: the median of each source with enough posts. No other day is read."""
    rows = spark.read.schema(SCHEMA).parquet(path).filter((F.col("day") > F.lit(last - dt.timedelta(days=days))) & (F.col("day") <= F.lit(last)))
    whole = rows.groupBy("source_id").agg(F.kll_merge_agg_bigint("sketch", F.lit(K)).alias("sketch"))
    out = whole.select("source_id", F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)).alias("usual"), F.kll_sketch_get_n_bigint("sketch").alias("posts"))
    return out.filter((F.col("posts") >= least) & (F.col("usual") > 0))
