"""Mixing sources to target weights by Pfair scheduling; DataFrame and SQL functions only.

Time is slots of one block (``block_rows`` rows of one source) each. A source with q of every PERIOD
slots may get its block j no earlier than its release floor(j * PERIOD / q) and must get it before
its deadline ceil((j + 1) * PERIOD / q). Serving, in each slot, the released block with the earliest
deadline (ties: the source that sorts first) meets every deadline, so after any slot every source is
less than one block away from its share. The schedule repeats every period; one period is worked out
as an SQL fold over its slots, and every block of every source, however many there are, finds its
slot in it by division. Sources of one quota have the same releases and deadlines and take turns, so
a step of the fold looks at quotas, of which a period has less than sqrt(2 * PERIOD), not at sources.
A period is PERIOD slots, or, with more than PERIOD / 4 sources, the next power of two that has four
for each.

Target weights are given, or proportional to rows ** alpha. Shares are whole slots of a period: each
source gets one, the rest go by weight and largest remainder. The mixture lasts until every row has
been placed once; a source that is through before starts again (``epoch``), so no row is dropped and
the shares hold to the end: the weights asked for are the weights kept. ``epochs``, where given, is the
most often that a row may be placed: weights that would ask for more are then lowered to what that
allows, and where the least share of one slot asks for more, the slots of a source that has had its
epochs stay empty.

Rows are ranked within their source by md5 of doc_id, then doc_id. The rank comes from a range sort
(a source that holds a third of all rows is many partitions) plus offsets of partitions; nothing but
tables of the size of sources, partitions or PERIOD is gathered.

Defined results: a null source is a source of its own, sorting first; sources without a positive
given weight get the smallest share, one slot; equal rows are placed separately; null doc_ids rank
first; an empty table gives no rows. Texts are carried along, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import documents, file_based, materialise, row_key

ALPHA = 0.7
BLOCK_ROWS = 16
PERIOD = 4096
#: Steps of the fold whose picks are appended to one array before it goes to the whole one.
STEPS = 512


def _ranked(docs: DataFrame, payload: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with key, partition and position; counts of each partition and source)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    rows = docs.select(*payload, key.alias("key"), F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")).alias("order"), F.col("doc_id").alias("tie"))
    rows = rows.repartitionByRange("key", "order", "tie").sortWithinPartitions("key", "order", "tie")
    rows = materialise(rows.drop("order", "tie").withColumn("at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return rows, counts.withColumn("skip", F.coalesce(before, F.lit(0)) - F.col("first"))


def shares(counts: DataFrame, weights: dict[str, float] | None, alpha: float, period: int, epochs: int | None = None) -> DataFrame:
    """key, i (place among the sources), total rows, q slots of a period. One row of each source."""
    totals = counts.groupBy("key").agg(F.sum("n").alias("total"))
    if weights is None:
        weight = F.pow("total", F.lit(float(alpha)))
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit("s" + k), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.greatest(F.coalesce(given[F.col("key")], F.lit(0.0)), F.lit(0.0))
    all_rows = Window.partitionBy()  # a window over one row of each source
    totals = totals.withColumn("weight", weight)
    if epochs is not None:
        least = F.min(F.when(F.col("weight") > 0, F.col("weight") / F.col("total"))).over(all_rows)  # the source that takes longest
        totals = totals.withColumn("weight", F.least("weight", F.col("total") * F.coalesce(least, F.lit(0.0)) * epochs))
    exact = F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(all_rows)), F.lit(0.0)) * (F.lit(period) - F.count(F.lit(1)).over(all_rows))
    out = totals.withColumn("exact", exact).withColumn("whole", F.floor("exact"))
    left = F.lit(period) - F.sum(F.col("whole") + 1).over(all_rows)
    by_rest = Window.orderBy((F.col("exact") - F.col("whole")).desc(), "key")
    return out.select(
        "key", "total",
        (F.row_number().over(Window.orderBy("key")) - 1).cast("int").alias("i"),
        # with all weights 0 the rest is spread evenly, over several rounds
        (F.col("whole") + 1 + F.floor((left - F.row_number().over(by_rest)) / F.count(F.lit(1)).over(all_rows)) + 1).cast("long").alias("q"),
    )


def period_slots(quota: DataFrame, period: int) -> DataFrame:
    """slot, i, k: the k-th block of source i in a period has this slot. `period` rows."""
    sources = F.array_sort(F.collect_list("i"))
    alike = quota.groupBy("q").agg(sources.alias("who"))
    one = alike.agg(F.array_sort(F.collect_list(F.struct("q", "who"))).alias("c"))
    # of each quota: when its next block is released, its deadline and source as one number, blocks so far; what[i]: place of source i's quota
    def state(done: str, q: str, who: str) -> str:
        turn = f"({done} div size({who}))"
        return f"named_struct('free', if({turn} >= {q}, {period + 1}L, {turn} * {period} div {q}), 'due', (({turn} + 1) * {period} + {q} - 1) div {q} * n + {who}[CAST({done} % size({who}) AS INT)], 'done', {done})"

    one = one.selectExpr(
        "c",
        "CAST(aggregate(c, 0L, (s, x) -> s + size(x.who)) AS BIGINT) AS n",
        "transform(array_sort(flatten(transform(c, (x, k) -> transform(x.who, i -> named_struct('i', i, 'k', k))))), y -> y.k) AS what",
    ).filter("size(c) > 0")
    begin = "transform(c, x -> " + state("0L", "x.q", "x.who") + ")"
    served = state("(a.s[k].done + 1L)", "c[k].q", "c[k].who")
    step = f"""
      aggregate(sequence(0L, {(period - 1) // STEPS}L), named_struct('s', {begin}, 'out', CAST(array() AS ARRAY<INT>)),
        (whole, part) -> transform(array(
          aggregate(sequence(part * {STEPS}L, least(part * {STEPS}L + {STEPS - 1}L, {period - 1}L)), named_struct('s', whole.s, 'out', CAST(array() AS ARRAY<INT>)),
            (a, t) -> transform(transform(array(CAST(array_min(transform(filter(a.s, x -> x.free <= t), x -> x.due)) % n AS INT)), i -> named_struct('i', i, 'k', what[i])), pick ->
              transform(array(pick.k), k -> named_struct('s', concat(slice(a.s, 1, k), array({served}), slice(a.s, k + 2, size(a.s))), 'out', concat(a.out, array(pick.i))))[0])[0])),
          b -> named_struct('s', b.s, 'out', concat(whole.out, b.out)))[0],
        whole -> whole.out)"""
    slots = one.select(F.posexplode(F.expr(step)).alias("slot", "i"))
    return slots.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1)


def mix(docs: DataFrame, payload: list[Column], weights: dict[str, float] | None = None, alpha: float = ALPHA, block_rows: int = BLOCK_ROWS, period: int = PERIOD, epochs: int | None = None) -> DataFrame:
    """payload, and of each placement: block, epoch, release, deadline, slot, place."""
    rows, counts = _ranked(docs, payload)
    counts = materialise(counts, "counts")
    sources = counts.select("key").distinct().count()
    while period < 4 * sources:
        period *= 2
    quota = materialise(shares(counts, weights, alpha, period, epochs), "quota")
    slots = materialise(period_slots(quota, period), "slots")
    quota = quota.withColumn("blocks", F.ceil(F.col("total") / block_rows))
    last = quota.select("i", F.col("blocks") - 1, (F.col("blocks") - 1) % F.col("q"), "q").toDF("i", "b", "k", "q")
    end = last.join(slots, ["i", "k"]).agg(F.max(F.floor(F.col("b") / F.col("q")) * period + F.col("slot"))).first()[0]
    end = -1 if end is None else end  # no rows at all
    times = F.ceil(F.lit(end // period + 1) * F.col("q") / F.col("blocks"))
    quota = quota.withColumn("epochs", times if epochs is None else F.least(times, F.lit(epochs)))
    names = rows.columns[: len(payload)]
    out = rows.join(counts.select("part", "key", "skip"), ["part", "key"]).join(quota.drop("total"), "key")
    out = out.withColumn("rank", F.col("at") + F.col("skip")).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    out = out.withColumn("block", F.floor(F.col("rank") / block_rows) + F.col("epoch") * F.col("blocks"))
    out = out.withColumn("k", (F.col("block") % F.col("q")).cast("int")).join(slots.withColumnRenamed("slot", "in_period"), ["i", "k"])
    out = out.withColumn("slot", F.floor(F.col("block") / F.col("q")) * period + F.col("in_period")).filter(F.col("slot") <= end)
    return out.select(
        *[f"`{n}`" for n in names], "block", "epoch",
        F.floor(F.col("block") * period / F.col("q")).alias("release"), F.ceil((F.col("block") + 1) * period / F.col("q")).alias("deadline"),
        "slot", (F.col("rank") % block_rows).alias("place"),
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs in the order of the mixture, as its files are read one after the other; all columns.

    Slots are worked out on the places of rows; texts move twice, once to their slots and once into order.
    """
    docs = file_based(docs)
    placed = materialise(mix(docs, list(row_key(docs)), **how).select("_file", "_row", "slot", "place"), "placed")
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    rows = docs.select(record, *row_key(docs)).join(placed, ["_file", "_row"])
    last = placed.agg(F.max("slot")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("slot") * parts / (last + 1)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("slot", "place").select("record.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), [F.col("doc_id"), F.col("source")])


ORACLE = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS key,
         row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id NULLS FIRST) - 1 AS rnk
  FROM documents),
t AS (SELECT key, count(*) AS total, pow(count(*), {ALPHA}) AS weight FROM r GROUP BY key),
p AS (SELECT CAST(greatest({PERIOD}, pow(2, ceil(log2(greatest(4 * count(*), 1))))) AS BIGINT) AS period FROM t),
c AS (SELECT key, total, weight FROM t),
e AS (SELECT *, weight / sum(weight) OVER () * (period - count(*) OVER ()) AS exact FROM c, p),
q AS (
  SELECT key, total, period, CAST(ceil(total / {BLOCK_ROWS}.0) AS BIGINT) AS blocks, row_number() OVER (ORDER BY key) AS i,
         CAST(floor(exact) + 1 + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, key) <= period - sum(floor(exact) + 1) OVER () THEN 1 ELSE 0 END AS BIGINT) AS q
  FROM e),
l AS (SELECT list(q ORDER BY i) AS q, max(period) AS period FROM q),
edf(slot, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), [CAST(0 AS BIGINT) FOR x IN q], CAST(0 AS BIGINT) FROM l
  UNION ALL
  SELECT slot + 1, [d + CASE WHEN i = p THEN 1 ELSE 0 END FOR d, i IN done], p
  FROM (SELECT slot, done, list_min([(done[i] * period + period + x - 1) // x * 1000000 + i FOR x, i IN q IF done[i] * period // x <= slot + 1]) % 1000000 AS p FROM edf, l WHERE slot < period - 1)),
s AS (SELECT slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k FROM edf WHERE slot >= 0),
h AS (SELECT max((blocks - 1) // q * period + slot) AS last FROM q JOIN s ON s.i = q.i AND s.k = (blocks - 1) % q.q),
x AS (
  SELECT doc_id, source, rnk, q.i, q.q, q.period, e.epoch, rnk // {BLOCK_ROWS} + e.epoch * blocks AS block
  FROM r JOIN q USING (key), h, LATERAL (SELECT unnest(range(CAST(ceil((last // period + 1) * q.q / blocks) AS BIGINT))) AS epoch) e)
SELECT doc_id, source, block, epoch, block * period // x.q AS release, ((block + 1) * period + x.q - 1) // x.q AS deadline,
       block // x.q * period + s.slot AS slot, rnk % {BLOCK_ROWS} AS place
FROM x JOIN s ON s.i = x.i AND s.k = block % x.q, h
WHERE block // x.q * period + s.slot <= last
"""
QUERIES = {"op4_source_mixing": query}
ORACLES = {"op4_source_mixing": ORACLE}
