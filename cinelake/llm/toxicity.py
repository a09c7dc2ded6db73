"""Toxicity by a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram of characters (code points; orders 4, 5, 6 and 8; A-Z lower-cased, other ASCII than letters and
digits as a space, so that starts and ends of words show), hashed to 2 ** BITS buckets. Over a bounded sample of labelled rows the
naive Bayes log-count ratio r of each bucket is taken; buckets whose class frequencies do not differ significantly have no weight, and
a logistic regression is fitted on presence times r of all others. A text's score is the logistic of the intercept plus the weights of
the distinct buckets that occur anywhere in it.

Training touches at most ``SAMPLE`` labelled rows, the same for each rerun (those with the least hash of their id). Scoring is a
map over partitions: no shuffle; the model has at most 2 ** BITS numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import chunks, crc_mod, documents, small_batches, stored, tidied

ORDERS = (4, 5, 6, 8)
BITS = 22
#: Buckets are counted in so many groups.
SLICES = 64
#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
#: Standard errors by which the class frequencies of a bucket must differ, and sampled texts that must have it.
SIGNIFICANT, LEAST = 5.0, 3

_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[b for b in range(128) if not chr(b).isalnum()]] = 32


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out


def characters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, ASCII normalised, and the offsets of the texts in them."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    starts = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return np.where(points < 128, _LOWER[np.minimum(points, 127)], points), starts[at]


def grams(points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket at each position, and whether the n-gram ends within its text."""
    ends = np.repeat(at[1:], np.diff(at))
    room = ends - np.arange(len(points))
    h = points.copy()
    for n in range(1, ORDERS[-1]):
        h = h[:-1] * np.uint32(0x9E3779B1) + points[n:]
        if n + 1 in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield mixed >> np.uint32(32 - BITS), room[: len(h)] > n


def _presence(raw: np.ndarray, at: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the distinct buckets in it. place: room for a number for each bucket, whose contents do not matter."""
    points, at = characters(raw, at)
    every = list(grams(points, at)) if len(points) else []
    for k in range(len(at) - 1):
        own = np.concatenate([b[at[k] : at[k + 1]][ok[at[k] : at[k + 1]]] for b, ok in every]) if every else np.zeros(0, np.uint32)
        order = np.arange(len(own), dtype=np.int32)
        place[own] = order
        yield own[place[own] == order]  # one position of each bucket


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, place = np.zeros((2, 1 << BITS), dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
    for batch in batches:
        for part, raw, at in chunks(batch, 1):
            for label, seen in zip(part.column(0).to_pylist(), _presence(raw, at, place), strict=True):
                counts[label, seen] += 1
    if counts.any():
        width = (1 << BITS) // SLICES
        for k in range(SLICES):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([counts[:, k * width : (k + 1) * width].tobytes()], pa.binary())], names=["slice", "counts"])


def _significance(n: np.ndarray):
    """Of a group of buckets, those whose class frequencies differ, and their log-count ratios, packed."""

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros((2, (1 << BITS) // SLICES), dtype=np.int64)
        for part in table.column("counts").to_pylist():
            counts += np.frombuffer(part, dtype=np.int32).reshape(2, -1)
        both = counts.sum(0) / n.sum()
        error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
        sure = np.abs(counts[1] / n[1] - counts[0] / n[0]) / error
        found = np.flatnonzero((sure > SIGNIFICANT) & (counts.sum(0) >= LEAST))
        rate = (counts[:, found] + 1) / (n + 2)[:, None]
        bucket = found.astype(np.int64) + table.column("slice")[0].as_py() * counts.shape[1]
        return pa.table({"buckets": pa.array([bucket.tobytes()], pa.binary()), "ratios": pa.array([np.log(rate[1] / rate[0]).tobytes()], pa.binary())})

    return run


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The bounded sample of labelled texts: label (0/1), text. Rows held out (crc32(doc_id) mod 5 = 0) never take part, nor do labels
    that are null or of a null id. Of several labels of an id the largest counts; each row of a repeated id is a text of its own."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).where("id is not null and label in (0, 1)").where(crc_mod("id", 5) != 0)
    some = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(some), "id").select("label", "text")  # at most `sample` rows of two numbers are broadcast


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model learned from at most ``sample`` labelled rows. Without rows of both classes it scores every text 0."""
    rows = stored(training_rows(docs, labels, sample).repartition(12), "toxicity-train")
    n = np.zeros(2)
    for row in rows.groupBy("label").count().collect():
        n[row["label"]] = row["count"]
    if not n.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    found = rows.mapInArrow(tidied(_frequencies), "slice long, counts binary").groupBy("slice").applyInArrow(_significance(n), "buckets binary, ratios binary").collect()  # at most 2 ** BITS
    chosen, ratio = np.concatenate([np.frombuffer(x["buckets"], np.int64) for x in found]), np.concatenate([np.frombuffer(x["ratios"]) for x in found])
    order = np.argsort(chosen)
    chosen, ratio = chosen[order], ratio[order]
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, place = np.full(1 << BITS, -1, dtype=np.int32), np.zeros(1 << BITS, dtype=np.int32)
        column[sent.value] = np.arange(len(sent.value))
        for batch in batches:
            for part, raw, at in chunks(batch, 1):
                found = [np.sort(column[seen]) for seen in _presence(raw, at, place)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[x >= 0].tobytes() for x in found], pa.binary())], names=["label", "found"])

    label, held = [], []
    for row in rows.mapInArrow(tidied(present), "label int, found binary").toLocalIterator():
        label.append(row["label"])
        held.append(np.frombuffer(row["found"], dtype=np.int32))
    weights, intercept = _logistic(held, np.array(label, dtype=np.float64), ratio)
    return Model(chosen, weights * ratio, intercept)


def _logistic(held: list[np.ndarray], label: np.ndarray, scale: np.ndarray, steps: int = 1000, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic regression on presence times ``scale``, by accelerated gradient descent."""
    order = sorted(range(len(held)), key=lambda k: (label[k], held[k].tobytes()))  # the rows' order must not change the result
    held, label = [held[k] for k in order], label[order]
    size = np.array([len(x) for x in held], dtype=np.int64)
    column = np.concatenate(held).astype(np.intp) if size.sum() else np.zeros(0, np.intp)
    by_column = np.argsort(column, kind="stable")
    row = np.repeat(np.arange(len(held)), size)[by_column]
    place = np.empty(len(column))

    def sums(values: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each run of ``at``, of the given sizes, the sum of the values there."""
        some = np.flatnonzero(sizes)
        out = np.zeros(len(sizes))
        if len(some):
            out[some] = np.add.reduceat(np.take(values, at, out=place, mode="clip"), (np.cumsum(sizes) - sizes)[some])
        return out

    has = np.bincount(column, minlength=len(scale))
    n = len(label)
    w, b = np.zeros(len(scale)), float(np.log(label.mean() / (1 - label.mean())))
    at_w, at_b, momentum = w, b, 1.0
    step = 4.0 / (1.0 + float(sums(scale * scale, column, size).max(initial=0.0)))
    for _ in range(steps):
        wrong = 1 / (1 + np.exp(-np.clip(sums(scale * at_w, column, size) + at_b, -30, 30))) - label
        grad = scale * sums(wrong, row, has) / n + penalty * at_w
        new_w, new_b = at_w - step * grad, at_b - step * wrong.mean()
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        at_w, at_b = new_w + (momentum - 1) / faster * (new_w - w), new_b + (momentum - 1) / faster * (new_b - b)
        w, b, momentum = new_w, new_b, faster
    return w, float(b)


def _totals(raw: np.ndarray, at: np.ndarray, table: np.ndarray, intercept: float) -> np.ndarray:
    """For each text the intercept and the weights of the distinct selected buckets in it."""
    keys = [np.zeros(0, np.int64)]
    points, at = characters(raw, at)
    for bucket, ok in grams(points, at):
        hit = np.flatnonzero((table[bucket] != 0) & ok)
        keys.append((np.searchsorted(at, hit, side="right") - 1) << BITS | bucket[hit])
    key = np.unique(np.concatenate(keys))
    return np.bincount(key >> BITS, table[key & (1 << BITS) - 1], minlength=len(at) - 1) + intercept


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id_column``, ``score`` (double, 0 to 1; higher: toxic likelier), ``predicted`` (int, 1 from 0.5).

    Only the whole text is looked at; a null text is empty, and an empty text gets the score of the intercept. Null and repeated
    ids are returned as they are, other columns are ignored, an empty table gives an empty result.
    """

    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = sent.value.table(), sent.value.intercept
        for batch in batches:
            for part, raw, at in chunks(batch, 1):
                total = _totals(raw, at, table, intercept)
                p = np.where(np.isneginf(total), 0.0, 1 / (1 + np.exp(-np.clip(total, -700, 700))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    rows = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "id long, score double, predicted int").withColumnRenamed("id", id_column)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with the same columns, whose text is not predicted toxic; a null text stays or goes as an empty one."""
    names, schema = docs.columns, docs.schema
    text = names.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = sent.value.table(), sent.value.intercept
        for batch in batches:
            for part, raw, at in chunks(batch, text):
                yield part.filter(pa.array(_totals(raw, at, table, intercept) < 0))

    return small_batches(docs).mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
