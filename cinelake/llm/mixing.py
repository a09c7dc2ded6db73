"""Mixing sources to target weights by weighted fair queueing.

Each source has a weight; the targets share the budget by weight, none above ``EPOCHS`` times its source (the excess is shared
again by weight among the others). Every document enters its source's queue once for each epoch, in an order shuffled by a hash of
its id, and its virtual finish time is the tokens of its source up to its end divided by the source's target. The mix is the
documents in order of finish time, cut where their tokens reach the budget.

Running totals are taken in two steps, so that no task holds a source: tokens are summed for each (source, hash range) first, and
only rows of one hash range are ordered together. The cut is found in the same way, by sums over ranges of finish time, narrowed
twice before rows are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.llm.common import documents, stored

#: Weights by the rank of a source, repeating.
WEIGHTS = (5, 2, 1)
#: Tokens of the mix for each token of the input.
BUDGET = 1.5
#: Times that a document may be taken.
EPOCHS = 2
SEED = "mix"
#: Ranges of finish time that are told apart at a time, for each unit; more than two units are one range.
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked(keys: DataFrame, order: list[Column]) -> DataFrame:
    """``keys`` with ``rank`` from 0 in global order: rows are ordered within ranges, and ranges are offset by their counts."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(keys.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "mixing-sources")
    counts = sorted((row["__part"], row["count"]) for row in parts.groupBy("__part").count().collect())
    before, rows = 0, []
    for part, count in counts:
        rows.append((part, before))
        before += count
    offsets = keys.sparkSession.createDataFrame(rows, "__part int, __before long")  # a row for each shuffle partition
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.join(F.broadcast(offsets), "__part").select(*keys.columns, (within + F.col("__before")).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """From ``source``, ``source_size``: the weight and the target of each source. Sources rank by code point, null last."""
    by_rank = ranked(sizes, [F.col("source").isNull().asc(), F.col("source").asc()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    known = stored(by_rank.withColumn("weight", weight.cast("long")).withColumn("cap", epochs * F.col("source_size")), "mixing-targets")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # the level rises until no further source is full
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        held, rest, n = known.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.sum(over.cast("long"))).first()
        if n == full or not rest or not total:
            break
        level, full = (budget * total - held) / rest, n
    level = float("inf") if total and not rest else level
    return known.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)))


def _cut(queue: DataFrame, budget: float) -> tuple[float, float, int, bool]:
    """Where the budget ends in ``queue`` (finish, size): least and greatest finish time of the narrow range that holds the end, the
    tokens before that range, and whether the budget is never reached."""
    low, width, before = 0.0, 1.0 / RANGES, 0
    rows = queue
    bounds = (0.0, float("inf"))
    for _ in range(2):
        place = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(2 * RANGES)).cast("long")
        sums = sorted((row["place"], row["size"]) for row in rows.groupBy(place.alias("place")).agg(F.sum("size").alias("size")).collect())
        for at, size in sums:
            if before + size > budget:
                break
            before += size
        else:
            return bounds[0], bounds[1], before, True
        inside = place == F.lit(at)
        rows = rows.where(inside)
        edge = rows.agg(F.min("finish"), F.max("finish")).first()
        bounds = edge
        low, width = edge[0], max((edge[1] - edge[0]) / RANGES, 1e-300)
    return bounds[0], bounds[1], before, False


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per input row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` (words that the mix takes).

    ``taken`` is 0 to ``epochs`` times ``size``. A null text has size 0 and takes nothing; a null source is a source; rows
    without an id or with the same id are queued by themselves; ties are ordered by id and size. A source without words has the target 0. The
    result depends on the rows alone, not on their partitions. An empty table gives an empty result.
    """
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))  # null as a key
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
    rows = rows.withColumn("key", named).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    rows = stored(rows.withColumn("part", F.substring("h", 1, 3)), "mixing-rows")
    sums = rows.groupBy("key", "part").agg(F.first("source").alias("source"), F.sum("size").alias("part_size"))
    sums = stored(sums, "mixing-sums")
    goal = targets(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("part_size").alias("source_size")), weights, budget, epochs)
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = sums.withColumn("before", before).join(goal.select("key", "source_size", "target"), "key").select("key", "part", "before", "source_size", "target")
    up_to = F.sum("size").over(Window.partitionBy("key", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("up_to", up_to).join(sums, ["key", "part"]).withColumn("up_to", F.col("up_to") + F.col("before"))
    placed = stored(placed.select("doc_id", "source", "key", "h", "size", "source_size", "target", "up_to"), "mixing-placed")

    def finish(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("up_to")) / F.col("target")

    queue = placed.where("size > 0").select("doc_id", "key", "h", "size", "source_size", "target", "up_to", F.explode(F.array(*map(F.lit, range(epochs)))).alias("epoch"))
    queue = queue.withColumn("finish", finish(F.col("epoch")))
    total = placed.agg(F.sum("size")).first()[0] or 0
    low, high, used, everything = _cut(queue.select("finish", "size"), budget * total)
    if everything:
        return placed.select("doc_id", "source", "size", "source_size", "target", (F.lit(epochs) * F.col("size")).alias("taken"))
    edge = queue.where(F.col("finish").between(F.lit(low), F.lit(high)))
    order = Window.orderBy("finish", "key", "epoch", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = edge.withColumn("all", F.sum("size").over(order) + F.lit(used)).where(F.col("all") <= F.lit(budget * total))
    end = last.agg(F.max(F.struct("finish", "key", "epoch", "h", "doc_id", "size")).alias("end")).first()["end"]
    taken = F.lit(0).cast("long")
    for epoch in range(epochs):
        at = finish(F.lit(epoch))
        within = at < F.lit(low)
        if end is not None:
            within = at < F.lit(end["finish"])
            same = F.struct(F.col("key"), F.lit(epoch), F.col("h"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))), F.col("size"))
            until = F.struct(F.lit(end["key"]), F.lit(end["epoch"]), F.lit(end["h"]), F.lit(end["doc_id"] if end["doc_id"] is not None else -(2**63)).cast("long"), F.lit(end["size"]).cast("long"))
            within = within | ((at == F.lit(end["finish"])) & (same <= until))
        taken = taken + F.when((F.col("size") > 0) & within, F.col("size")).otherwise(F.lit(0).cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || doc_id) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS full_at,
         CAST(coalesce(sum(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS held,
         CAST(sum(weight) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM w),
level AS (SELECT (1.5::DOUBLE * total - held) / rest AS level FROM r WHERE (1.5::DOUBLE * total - held) / rest <= full_at ORDER BY full_at, source LIMIT 1),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * level) AS target, total FROM r, level),
q AS (
  SELECT d.doc_id, d.source, d.h, d.size, e.epoch, t.total, t.source_size, t.target,
         CAST(e.epoch * t.source_size + sum(d.size) OVER (PARTITION BY d.source, e.epoch ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / t.target AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) e(epoch)),
c AS (
  SELECT *, CASE WHEN size > 0 AND CAST(sum(size) OVER (ORDER BY finish, source NULLS FIRST, epoch, h, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) <= 1.5::DOUBLE * total
                 THEN size ELSE 0 END AS part
  FROM q)
SELECT doc_id, size, source_size, target, CAST(sum(part) AS BIGINT) AS taken FROM c GROUP BY doc_id, size, source_size, target
"""
