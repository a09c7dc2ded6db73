"""Connected components of links, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import checkpointed, tidied


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each node of ``pairs`` but the smallest of its component, the node and that smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer links with the same components: batch by batch, none is held longer."""
    for batch in batches:
        found = forest(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """From links ``a``, ``b`` (long) each linked ``node`` with the smallest node of its component, ``root``.

    Links may repeat and have either direction; nulls and links of a node with itself are ignored. Neighbours of a node are never
    brought together: each step takes minima by groups, which are summed up before the shuffle.
    """
    edges = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpointed(edges.mapInArrow(tidied(_local), "a long, b long").distinct())  # a > b throughout
    before = None
    while True:
        # large star: each neighbour above a node goes to the least node around it
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a node and its neighbours below go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("m"), F.col("a"))
        edges = checkpointed(small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
