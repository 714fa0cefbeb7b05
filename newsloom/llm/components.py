"""Connected components of an edge table, with alternating large-star and small-star steps.

Each step is an aggregation with map-side combine and a join; the edge table of every round is
written to the shared folder, so lineage stays short and a lost executor costs one round; a round's
tables go when the next one is written. Rounds grow with the logarithm of the largest component.
Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Scratch, drop_table, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). Large: link larger neighbours to the least one around; small: link the smaller ones and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # a written table, not an aggregation, on the other side: so Spark can split a hub's rows over tasks
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    near = both.join(least, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of its component) for every node of an edge, as a written table. edges: columns a, b of long."""
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        before = None
        while True:
            n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if not n or before == (n, total):
                return scratch.keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct()), "labels")
            before = n, total
            with Scratch(spark) as round_:
                after = round_.keep(_star(_star(now, large=True), large=False), "edges")
            drop_table(now)
            now = after
