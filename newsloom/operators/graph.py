"""Iterations over edge and pointer tables; each round is written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where one machine does everything, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a table of its own: computed once, lineage cut, safe from lost executors."""
    return counted_cut(df, None)[0]


def counted_cut(df: DataFrame, what: Column | None) -> tuple[DataFrame, int]:
    """cut(df), and how many of its rows hold `what`, counted while they are written."""
    path = f"{shared_folder(df.sparkSession)}/newsloom-cut-{uuid.uuid4().hex}"
    schema, seen = df.schema, Observation()
    (df if what is None else df.observe(seen, F.count_if(what).alias("n"))).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), 0 if what is None else seen.get["n"]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Id, component (its least id). nodes: id; edges: a, b. Labels travel along edges, then jump to their label's label."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        moved = labels.join(near, "id", "left").select("id", F.least("component", "least").alias("component"), F.col("component").alias("before"))
        jump = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
        now, changed = counted_cut(moved.join(jump, "component", "left").select("id", F.least("component", "to").alias("component"), "before"), F.col("component") != F.col("before"))
        if not changed:
            return now.select("id", "component")
        labels = now.select("id", "component")


class GrowingComponents:
    """D05/D12 in increments: components of all edges so far, where new edges touch what they join alone.

    nodes: id, component it entered with, only ever appended to; merged: component, into: where components went
    that are one with another now, each in one step. An increment looks up the ends of its edges, works on
    the graph of the components that they join, and redirects these.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.nodes = [spark.createDataFrame([], "id bigint, component bigint")]
        self.merged = spark.createDataFrame([], "component bigint, into bigint")

    def _known(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.nodes)

    def add(self, edges: DataFrame) -> None:
        """edges: a, b."""
        edges = cut(edges.select("a", "b"))
        ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).filter("id IS NOT NULL").distinct()
        found = ends.join(self._known(), "id", "left").join(self.merged, "component", "left")
        now = cut(found.select("id", F.coalesce("into", "component", "id").alias("now"), F.col("component").isNull().alias("new")))
        joined = edges.join(now.select(F.col("id").alias("a"), F.col("now").alias("x")), "a").join(now.select(F.col("id").alias("b"), F.col("now").alias("y")), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = cut(joined.distinct())
        touched = joined.select(F.col("a").alias("id")).union(joined.select("b")).distinct()
        moved = components(touched, joined).filter("id <> component").select(F.col("id").alias("component"), F.col("component").alias("into"))
        further = moved.select(F.col("component").alias("into"), F.col("into").alias("further"))
        self.nodes.append(cut(now.filter("new").select("id", F.col("id").alias("component"))))
        if len(self.nodes) > 16:
            self.nodes = [cut(self._known())]
        self.merged = cut(self.merged.join(further, "into", "left").select("component", F.coalesce("further", "into").alias("into")).unionByName(moved))

    def labels(self) -> DataFrame:
        """id, component (its least id) of all nodes of edges so far."""
        return self._known().join(self.merged, "component", "left").select("id", F.coalesce("into", "component").alias("component"))


def follow(pointers: DataFrame) -> DataFrame:
    """Id, last: where each chain of pointers (id -> to) ends; a cycle ends at its least id."""
    now = cut(pointers.filter("id <> to").select("id", F.col("to").alias("last"), F.least("id", "to").alias("least")))
    rounds = 1
    total = now.count()
    while True:
        step = now.select(F.col("id").alias("last"), F.col("last").alias("next"), F.col("least").alias("step_least"))
        moved = now.join(step, "last", "left").select("id", F.coalesce("next", "last").alias("last"), F.least("least", "step_least").alias("least"), F.col("next").isNotNull().alias("more"))
        now, moving = counted_cut(moved, F.col("more"))
        rounds *= 2
        if not moving:
            return now.select("id", "last")
        if rounds > 2 * total:  # whoever still moves is in, or leads into, a cycle
            return now.select("id", F.when(F.col("more"), F.col("least")).otherwise(F.col("last")).alias("last"))
        now = now.drop("more")
