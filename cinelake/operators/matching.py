"""Nearest neighbours of frames within a cluster, with the ratio test, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO = 0.7
#: Rows of a cluster that meet in one task, on either side.
BLOCK = 4096


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "hamming":
        out = np.zeros((len(a), len(b)), dtype=np.int64)
        for k in range(a.shape[1]):
            out += np.bitwise_count((a[:, k, None] ^ b[:, k]).astype(np.uint8))
        return out
    a, b = a.astype(np.int64), b.astype(np.int64)
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T


def nearest_two(frames: DataFrame, metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """For each frame the two nearest others of its cluster: frame_no, first, d1, second, d2 (squared, or bits that differ).

    ``frames`` has frame_no, cluster_id and px. A cluster is dealt to pieces, and each pair of pieces meets in one task that sends on
    two rows for each frame. Ties go to the lower number; a frame without two others has nulls.
    """
    pieces = frames.groupBy("cluster_id").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    rows = frames.join(pieces, "cluster_id").withColumn("i", F.pmod(F.xxhash64("frame_no"), "n").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = rows.select("cluster_id", "frame_no", "px", "i", every.alias("j"))
    right = rows.select("cluster_id", "frame_no", "px", F.col("i").alias("j"), every.alias("i"))
    right = right.toDF(*right.columns)  # columns of its own

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        own, other = np.array(a.column("frame_no").to_pylist(), np.int64), np.array(b.column("frame_no").to_pylist(), np.int64)
        x, y = np.array(a.column("px").to_pylist(), np.int64), np.array(b.column("px").to_pylist(), np.int64)
        out: list[tuple[int, int, int]] = []
        order = np.argsort(other, kind="stable")
        other, y = other[order], y[order] if len(y) else y
        for low in range(0, len(own) if len(other) else 0, 256):
            d = _distances(x[low : low + 256], y, metric)
            d[own[low : low + 256, None] == other] = np.iinfo(np.int64).max
            for k, row in enumerate(d):
                for at in np.argsort(row, kind="stable")[:2].tolist():
                    if row[at] < np.iinfo(np.int64).max:
                        out.append((int(own[low + k]), int(row[at]), int(other[at])))
        return pa.table({name: pa.array([x[k] for x in out], pa.int64()) for k, name in enumerate(("frame_no", "d", "other"))})

    key = ["cluster_id", "i", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "frame_no long, d long, other long")
    best = found.groupBy("frame_no").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, 2).alias("x"))
    out = frames.select("frame_no").join(best, "frame_no", "left")
    at = lambda k, name: F.try_element_at("x", F.lit(k))[name]
    return out.select("frame_no", at(1, "other").alias("first"), at(1, "d").alias("d1"), at(2, "other").alias("second"), at(2, "d").alias("d2"))


def ratio_matches(frames: DataFrame, ratio: float = RATIO, metric: str = "l2") -> DataFrame:
    """Nearest neighbours that are clearly nearer than the next: distance below ``ratio`` of it."""
    rows = nearest_two(frames, metric)
    near, far = F.col("d1").cast("double"), F.col("d2").cast("double")
    ok = near < far * ratio if metric == "hamming" else F.sqrt(near) < F.sqrt(far) * ratio
    return rows.withColumn("good", F.coalesce(ok, F.lit(False)))


def radius_matches(frames: DataFrame, radius: float, ratio: float = RATIO, metric: str = "l2") -> DataFrame:
    """Matches within a radius: by the ratio test, or alone where the distance over the ratio is still within it."""
    rows = nearest_two(frames, metric)
    near = F.col("d1").cast("double") if metric == "hamming" else F.sqrt(F.col("d1").cast("double"))
    far = F.col("d2").cast("double") if metric == "hamming" else F.sqrt(F.col("d2").cast("double"))
    paired = (far <= radius) & (near < ratio * far)
    alone = (far.isNull() | (far > radius)) & (near / ratio < radius)
    return rows.where(F.coalesce(near <= radius, F.lit(False)) & F.coalesce(paired | alone, F.lit(False)))
