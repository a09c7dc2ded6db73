"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph (largest inner products); the graph is cut into partitions of equal size
with few edges between them; and a small classifier learns from a vector in which partitions its neighbours are. Every row is put
in the partition that the classifier finds most probable, and a query is compared with all rows of its several most probable
partitions; the number of these is the least with which held-out vectors of the sample reach the wanted recall against brute force.
Of several numbers of partitions that is taken which has the smallest share of the rows looked at. A query whose partitions hold fewer
rows than it wants goes on to the next most probable ones.

Rows and queries of a partition meet in blocks of bounded size, and each block sends on only the best of each query. Of the
corpus, the driver sees the sample and the sizes of the partitions. A sample with fewer than LEAST vectors a partition for every number
of partitions gives one partition, that is an exhaustive search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.llm.common import embeddings, stored
from cinelake.llm.vectors import matrix, sample, usable

#: Vectors that the index is fitted on, at most; one in eight of them is held out to choose the number of partitions to look in.
SAMPLE = 8192
#: Numbers of partitions that are tried, and sampled vectors of each that are needed.
PARTITIONS, LEAST = (16, 64), 8
#: Neighbours of a vector in the graph.
DEGREE = 16
HIDDEN = 64
RECALL = 0.95
#: Rows of a partition that are compared in one task, and queries.
ROWS, QUERIES = 65_536, 8_192


@dataclass(frozen=True)
class Index:
    """The classifier, the partitions to look in, and the recall on the held-out vectors of the sample."""

    layers: tuple[np.ndarray, ...]
    probes: int
    recall: float

    def order(self, x: np.ndarray) -> np.ndarray:
        """For each vector the partitions, most probable first."""
        return np.argsort(-_forward(self.layers, x)[1], axis=1, kind="stable")


def _forward(layers: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale, w1, b1, w2, b2 = layers
    hidden = np.maximum(x * scale @ w1 + b1, 0)
    return hidden, hidden @ w2 + b2


def _nearest(queries: np.ndarray, rows: np.ndarray, k: int, own: bool) -> np.ndarray:
    """For each query the places of the ``k`` rows with the largest inner products, without itself where rows are the queries."""
    out = []
    for at in range(0, len(queries), 1024):
        s = queries[at : at + 1024] @ rows.T
        if own:
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    """A part for each node: equal sizes, few edges between parts. Halves along main directions, then moves to where neighbours are."""
    part = np.zeros(len(x), dtype=np.int64)
    for _ in range(parts.bit_length() - 1):
        new = part * 2
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            own = x[at] - x[at].mean(0)
            along = own @ np.linalg.eigh(own.T @ own)[1][:, -1]
            new[at[np.argsort(along, kind="stable")[len(at) // 2 :]]] += 1
        part = new
    most = -(-len(x) // parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        for column in range(graph.shape[1]):
            votes[np.arange(len(x)), part[graph[:, column]]] += 1
            np.add.at(votes, (graph[:, column], part), 1)
        wanted = votes.argmax(1)
        gain = votes[np.arange(len(x)), wanted] - votes[np.arange(len(x)), part]
        room = most - np.bincount(part, minlength=parts)
        moved = 0
        waiting: dict[tuple[int, int], list[int]] = {}
        for k in np.argsort(-gain, kind="stable"):
            if gain[k] <= 0:
                break
            a, b = int(part[k]), int(wanted[k])
            if waiting.get((b, a)):  # two that want each other's part change places
                other = waiting[b, a].pop()
                part[k], part[other] = b, a
                moved += 2
            elif room[b] > 0:
                room[a], room[b], part[k] = room[a] + 1, room[b] - 1, b
                moved += 1
            else:
                waiting.setdefault((a, b), []).append(int(k))
        if moved * 200 < len(x):
            break
    return part


def _learned(x: np.ndarray, goal: np.ndarray, seed: int = 7, epochs: int = 40) -> tuple[np.ndarray, ...]:
    """The classifier: one hidden layer, fitted to the shares ``goal`` of each vector's neighbours by partition."""
    rng = np.random.default_rng(seed)
    scale = np.array(1 / max(np.sqrt((x * x).mean()), 1e-300))
    weights = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, goal.shape[1])), np.zeros(goal.shape[1])]
    first, second, t = [0 * w for w in weights], [0 * w for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            own = order[at : at + 256]
            hidden, out = _forward((scale, *weights), x[own])
            p = np.exp(out - out.max(1, keepdims=True))
            wrong = (p / p.sum(1, keepdims=True) - goal[own]) / len(own)
            back = wrong @ weights[2].T * (hidden > 0)
            slopes = [(x[own] * scale).T @ back, back.sum(0), hidden.T @ wrong, wrong.sum(0)]
            t += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                weights[k] = weights[k] - 0.003 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return (scale, *weights)


def fit(x: np.ndarray, k: int = 20, parts: tuple[int, ...] = PARTITIONS, recall: float = RECALL) -> Index:
    """The index fitted on a sample. With few vectors there is one partition, which holds all."""
    held = np.arange(len(x)) % 8 == 7
    rows, asked = x[~held], x[held]
    best, share = Index((np.array(1.0), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1, 1.0), 1.0
    if len(rows) <= max(DEGREE, k):
        return best
    graph, wanted = _nearest(rows, rows, DEGREE, True), _nearest(asked, rows, k, False)
    for count in parts:
        if len(rows) < LEAST * count or count < 2:
            continue
        part = balanced(rows, graph, count)
        goal = np.zeros((len(rows), count))
        for column in range(DEGREE):
            goal[np.arange(len(rows)), part[graph[:, column]]] += 1 / DEGREE
        index = Index(_learned(rows, goal), count, 1.0)
        home = index.order(rows)[:, 0]
        order = index.order(asked)
        looked = np.argsort(order, axis=1)  # in which place a query looks in a partition
        found = np.sort(np.take_along_axis(looked, home[wanted], axis=1).ravel())
        sizes = np.cumsum(np.bincount(home, minlength=count)[order], axis=1).mean(axis=0) / len(rows)
        probes = next(n for n in range(1, count + 1) if np.searchsorted(found, n) >= recall * len(found) or n == count)
        if best.probes == 1 and share == 1.0 or sizes[probes - 1] < share:
            best, share = Index(index.layers, probes, float(np.searchsorted(found, probes) / len(found))), float(sizes[probes - 1])
    return best


def _best(held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate([held[0], ids]), np.concatenate([held[1], scores])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _compare(k: int):
    """Of a block, the best ``k`` rows of each query."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, x = np.array(rows.column("id").to_pylist(), np.int64), matrix(rows.column("v").to_pylist())
        queries, q = asked.column("id").to_pylist(), matrix(asked.column("v").to_pylist())
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries) if len(ids) else 0, 256):
            held = [(np.zeros(0, np.int64), np.zeros(0))] * len(q[at : at + 256])
            for low in range(0, len(ids), 8192):
                s = q[at : at + 256] @ x[low : low + 8192].T
                n = min(k + 1, s.shape[1])
                edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                edge -= 1e-9 * (1 + np.abs(s).max(axis=1))  # rounding of the product must not decide
                for j in range(len(s)):
                    near = low + np.flatnonzero(s[j] >= edge[j])
                    near = near[ids[near] != queries[at + j]]
                    held[j] = _best(held[j], ids[near], (x[near] * q[at + j]).sum(axis=1), k)
            out += [(queries[at + j], *x) for j, x in enumerate(held)]
        return pa.table({"query": pa.array([x[0] for x in out], pa.int64()), "ids": pa.array([x[1] for x in out], pa.list_(pa.int64())), "scores": pa.array([x[2] for x in out], pa.list_(pa.float64()))})

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 20, index: Index | None = None) -> DataFrame:
    """The ``k`` rows with the largest inner products found for each query: ``query``, ``rank`` (from 1), ``id``, ``score``.

    Both inputs have ``id`` and ``v``, as ``vectors.usable`` gives them; a row is no neighbour of the query of the same id, and
    ties go to the smaller id. Rows and queries of different dimensions do not meet; each dimension has an index of its own. A query
    has all rows where there are no more than ``k``. Empty inputs give an empty result.
    """
    sizes = [row["size"] for row in queries.select(F.octet_length("v").alias("size")).distinct().collect()]  # a row for each dimension
    parts = [_search(rows.where(F.octet_length("v") == size), queries.where(F.octet_length("v") == size), k, index) for size in sizes]
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], "query long, rank int, id long, score double")


def _search(rows: DataFrame, queries: DataFrame, k: int, index: Index | None) -> DataFrame:
    spark = rows.sparkSession
    if index is None:
        x = sample(rows, SAMPLE)[1]
        if not len(x):
            return spark.createDataFrame([], "query long, rank int, id long, score double")
        index = fit(x, k)
    model = spark.sparkContext.broadcast(index)

    def placed(held: np.ndarray | None):
        """The most probable partition of each row; of a query those to look in, so many that they hold ``k`` rows besides its own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    order = model.value.order(matrix(batch.column(1).to_pylist())).astype(np.int32)
                    if held is None:
                        own = list(order[:, :1])
                    else:
                        enough = (np.cumsum(held[order], axis=1) <= k).sum(axis=1) + 1
                        own = [x[: max(index.probes, n)] for x, n in zip(order, enough.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], names=["id", "v", "parts"])

        return run

    schema = "id long, v binary, parts array<int>"
    at = stored(rows.mapInArrow(placed(None), schema), "ann-rows").select("id", "v", F.explode("parts").alias("part"))
    counts = {row["part"]: row["count"] for row in at.groupBy("part").count().collect()}  # a row for each partition
    held = np.array([counts.get(p, 0) for p in range(index.layers[-1].shape[0])], dtype=np.int64)
    asked = stored(queries.mapInArrow(placed(held), schema), "ann-queries").select("id", "v", F.explode("parts").alias("part"))
    n_asked = {row["part"]: -(-row["count"] // QUERIES) for row in asked.groupBy("part").count().collect()}
    table = spark.createDataFrame([(p, max(1, -(-counts.get(p, 0) // ROWS)), n_asked.get(p, 1)) for p in {*counts, *n_asked}], "part int, n_rows int, n_asked int")
    sized = F.broadcast(table)  # a row for each partition
    left = at.join(sized, "part").select("id", "v", "part", F.pmod(F.xxhash64("id"), "n_rows").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_asked").cast("long") - 1)).alias("j"))
    right = asked.join(sized, "part").select("id", "v", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows").cast("long") - 1)).alias("i"), F.pmod(F.xxhash64("id"), "n_asked").alias("j"))
    key = ["part", "i", "j"]
    blocks = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_compare(k), "query long, ids array<long>, scores array<double>")
    pairs = blocks.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))  # the best k of each task go on, no more
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def recall(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 20) -> float:
    """The share of true neighbours in ``found``, by brute force: for tests and measurements on samples of queries."""
    queries, every = queries.collect(), rows.collect()
    ids, x = np.array([row["id"] for row in every], np.int64), matrix([bytes(row["v"]) for row in every])
    got: dict[int, set[int]] = {}
    for row in found.collect():
        got.setdefault(row["query"], set()).add(row["id"])
    hits = total = 0
    for row in queries:
        s = x @ np.frombuffer(row["v"])
        s[ids == row["id"]] = -np.inf
        true = ids[np.lexsort((ids, -s))][: min(k, len(ids) - (row["id"] in ids))]
        hits += len(got.get(row["id"], set()).intersection(true.tolist()))
        total += len(true)
    return hits / max(total, 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(usable(embeddings(spark, sf_dir)), "ann-vectors")
    return search(rows, rows.where("id % 20 = 0")).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
