"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of at least c are at a squared distance of at most 2 (1 - c). Vectors are rotated and split into blocks
of a few dimensions, and each block gets a share of that budget in proportion to its dimensions: a pair that links is within the
share in one block at least. Each block is range-joined: its first coordinates are cut into cells as wide as the share's radius, and
a cell is compared with itself and with its neighbours. Candidates are verified with the exact cosine in double precision.

A pair is counted in the first of the blocks where it is within the share, so no pair is counted twice and none is sent: a cell
sends on, for each vector, the number of its links and one link that keeps the components. Equal vectors are one vector with a
multiplicity from the start. A full cell is cut into pieces of bounded size; rows of neighbour cells pass by it in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import embeddings, last_long, stored
from cinelake.llm.components import components, forest
from cinelake.llm.vectors import matrix, sample, usable

COSINE = 0.95
#: Dimensions of a block, and coordinates of a block that cells are made of.
BLOCK, GRID = 16, 2
#: Vectors that the rotation is taken from, at most.
SAMPLE = 4096
#: Rows of a cell that are compared in one task.
PIECE = 8192
#: Room for rounding in squared distances of unit vectors.
SLACK = 1e-9


class Blocks:
    """The rotation and the blocks for vectors of one dimension."""

    def __init__(self, x: np.ndarray, cosine: float) -> None:
        d = x.shape[1]
        unit = x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else np.eye(d)
        axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]  # main directions first; dealt to the blocks in turn, so that cells tell apart
        count = max(1, -(-d // BLOCK))
        self.axes = axes[:, np.concatenate([np.arange(k, d, count) for k in range(count)])]
        self.edges = np.cumsum([0, *[len(range(k, d, count)) for k in range(count)]])
        self.cosine = cosine
        self.budget = 2 * (1 - cosine) * np.diff(self.edges) / d + SLACK

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(1, keepdims=True)) @ self.axes

    def cells(self, rotated: np.ndarray) -> np.ndarray:
        """For each vector and block the cell, as one number."""
        out = np.zeros((len(rotated), len(self.budget)), dtype=np.int64)
        for k, budget in enumerate(self.budget):
            width = np.sqrt(budget) * (1 + 1e-6)
            for c in range(min(GRID, self.edges[k + 1] - self.edges[k])):
                out[:, k] = out[:, k] * self.span(k) + np.floor((rotated[:, self.edges[k] + c] + 1) / width).astype(np.int64) + 1
        return out

    def span(self, k: int) -> int:
        """Cells along a coordinate, with one more at each end."""
        return int(2 / np.sqrt(self.budget[k])) + 4

    def steps(self, k: int) -> list[int]:
        """To the neighbours of a cell that come after it, as differences of cell numbers."""
        grid = min(GRID, int(self.edges[k + 1] - self.edges[k]))
        around = np.array(np.meshgrid(*[[-1, 0, 1]] * grid)).reshape(grid, -1).T
        return sorted(x for x in (around @ self.span(k) ** np.arange(grid)[::-1]).tolist() if x > 0)

    def within(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of rotated vectors, whether each block is within its share. The same for (b, a)."""
        return np.add.reduceat((a - b) ** 2, self.edges[:-1], axis=1) <= self.budget


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


class _Cell:
    """The rows at home in a cell piece, and what is found for them and for rows that pass by."""

    def __init__(self, blocks: Blocks, block: int) -> None:
        self.blocks, self.block = blocks, block
        self.low, self.high = blocks.edges[block], blocks.edges[block + 1]
        self.ids, self.times, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, blocks.axes.shape[0]))
        self.turned = self.rows
        self.count: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def meet(self, ids: np.ndarray, times: np.ndarray, rows: np.ndarray, home: bool) -> None:
        turned = self.blocks.rotated(rows)
        for at in range(0, len(ids), 512):
            part = slice(at, at + 512)
            self._match(self.ids, self.times, self.rows, self.turned, ids[part], times[part], rows[part], turned[part])
            if home:
                self._match(ids[part], times[part], rows[part], turned[part], ids[part], times[part], rows[part], turned[part], True)
                self.ids, self.times = np.concatenate([self.ids, ids[part]]), np.concatenate([self.times, times[part]])
                self.rows, self.turned = np.concatenate([self.rows, rows[part]]), np.concatenate([self.turned, turned[part]])

    def _match(self, ids, times, rows, turned, ids2, times2, rows2, turned2, same: bool = False) -> None:
        if not len(ids) or not len(ids2):
            return
        a, b = turned[:, self.low : self.high], turned2[:, self.low : self.high]
        near = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T <= self.blocks.budget[self.block] + SLACK
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        for k in range(0, len(i), 100_000):
            self._keep(i[k : k + 100_000], j[k : k + 100_000], ids, times, rows, turned, ids2, times2, rows2, turned2)

    def _keep(self, i, j, ids, times, rows, turned, ids2, times2, rows2, turned2) -> None:
        within = self.blocks.within(turned[i], turned2[j])
        first = within[:, self.block] & ~within[:, : self.block].any(axis=1)  # counted in the first block within its share
        i, j = i[first], j[first]
        linked = _cosines(rows[i], rows2[j]) >= self.blocks.cosine
        i, j = i[linked], j[linked]
        for own, other in ((ids[i], times2[j]), (ids2[j], times[i])):
            nodes, place = np.unique(own, return_inverse=True)
            for node, n in zip(nodes.tolist(), np.bincount(place, other, len(nodes)).tolist(), strict=True):
                self.count[node] = self.count.get(node, 0) + int(n)
        self.links += zip(ids[i].tolist(), ids2[j].tolist(), strict=True)
        if len(self.links) > 200_000:
            self.links = forest(self.links)

    def out(self) -> pa.RecordBatch:
        root = dict(forest(self.links))
        ids = list(self.count)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root.get(x, x) for x in ids], pa.int64()), pa.array([self.count[x] for x in ids], pa.int64())], names=["id", "root", "n"])


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """For each distinct vector with links, how many and one that leads to its component: ``id``, ``root``, ``n``; several rows an id.

    ``vectors`` has ``id``, ``v`` (packed doubles, no two equal) and ``times`` (its multiplicity). Only vectors of the same
    dimension can link; those of another dimension than most of a bounded sample are compared by themselves.
    """
    spark = vectors.sparkSession
    out = []
    for row in vectors.groupBy(F.octet_length("v").alias("size")).count().collect():  # a row for each dimension
        own = vectors.where(F.octet_length("v") == row["size"])
        blocks = spark.sparkContext.broadcast(Blocks(sample(own, SAMPLE)[1], cosine))
        out.append(_links(own, blocks))
    return out[0] if len(out) == 1 else _union(out) if out else spark.createDataFrame([], "id long, root long, n long")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _links(vectors: DataFrame, blocks) -> DataFrame:
    spark = vectors.sparkSession

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = blocks.value
        for batch in batches:
            if batch.num_rows:
                cells = own.cells(own.rotated(matrix(batch.column("v").to_pylist())))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int64()))], names=["id", "v", "times", "cells"])

    placed = stored(vectors.select("id", "v", "times").mapInArrow(celled, "id long, v binary, times long, cells array<long>"), "dedup-cells")
    # the number of cells is bounded by the width of the shares, not by the rows: (span ** GRID) for each block
    counts = placed.select(F.posexplode("cells").alias("block", "cell")).groupBy("block", "cell").count().where(F.col("count") > PIECE)
    full = spark.sparkContext.broadcast({(row["block"], row["cell"]): -(-row["count"] // PIECE) for row in counts.collect()})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = blocks.value, full.value
        steps = [own.steps(k) for k in range(len(own.budget))]
        for batch in batches:
            row, tile, role = [], [], []
            for at, (name, cells) in enumerate(zip(batch.column("id").to_pylist(), batch.column("cells").to_pylist(), strict=True)):
                for block, cell in enumerate(cells):
                    n = pieces.get((block, cell), 1)
                    mine = name * 0x9E3779B97F4A7C15 % (1 << 64) * n >> 64
                    for piece in range(mine + 1):  # at home in one piece, passing by those before it
                        row.append(at)
                        tile.append((block, cell, piece))
                        role.append(int(piece != mine))
                    for step in steps[block]:
                        for piece in range(pieces.get((block, cell - step), 1)):
                            row.append(at)
                            tile.append((block, cell - step, piece))
                            role.append(1)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in tile], pa.int32()), pa.array([x[1] for x in tile], pa.int64()), pa.array([x[2] for x in tile], pa.int32()), pa.array(role, pa.int32()), *[batch.column(name).take(take) for name in ("id", "times", "v")]], names=["block", "cell", "piece", "role", "id", "times", "v"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, cell = blocks.value, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                tile = tuple(keys[:3, low])
                if tile != at:
                    if cell is not None:
                        yield cell.out()
                    at, cell = tile, _Cell(own, int(tile[0]))
                home = keys[3, low] == 0
                if home or len(cell.ids):  # rows pass by a cell where nobody is at home
                    part = batch.slice(low, high - low)
                    cell.meet(part.column("id").to_numpy(), part.column("times").to_numpy(), matrix(part.column("v").to_pylist()), home)
        if cell is not None:
            yield cell.out()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = placed.mapInArrow(sent, "block int, cell long, piece int, role int, id long, times long, v binary")
    return tiles.repartition(n, "block", "cell", "piece").sortWithinPartitions("block", "cell", "piece", "role").mapInArrow(joined, "id long, root long, n long")


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per distinct id: ``id`` (long, null as the largest), ``n_links``, ``component_id`` (long) and ``kept`` (boolean).

    Two vectors link when their cosine is at least ``cosine``, equal ones included. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, as do vectors of different dimensions. Rows of the same id are one vector, the least.
    Other columns are ignored. An empty table gives an empty result.
    """
    good = stored(usable(rows, id_column, vector_column), "dedup-vectors")
    classes = stored(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("times")), "dedup-classes")
    found = stored(links(classes.select(F.col("rep").alias("id"), "v", "times"), cosine), "dedup-links")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    reps = classes.join(counts, classes["rep"] == counts["id"], "left").drop("id").join(roots, F.col("rep") == F.col("node"), "left")
    reps = reps.select("v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = good.join(reps, "v").select("id", "n_links", "component_id")
    ids = rows.select(last_long(id_column).alias("id")).distinct()
    out = ids.join(linked, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(embeddings(spark, sf_dir)).withColumnRenamed("id", "vec_id")


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0 AND len([y FOR y IN embedding IF y <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN counts USING (vec_id)
"""
