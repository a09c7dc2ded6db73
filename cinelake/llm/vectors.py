"""Vectors as packed doubles, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import last_long


def usable(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id`` (long, null as the largest) and ``v`` (packed doubles) of the rows whose vector is not null, not empty, not zero, and has
    neither null nor non-finite components. Rows of the same id give one row, with the least of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for k, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = vector.values
                if values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and x.any():
                    ids.append(k)
                    vectors.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["id", "v"])

    packed = rows.select(last_long(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("x")).mapInArrow(run, "id long, v binary")
    return packed.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1) if column else np.zeros((0, 1))


def sample(vectors: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``most`` rows, the same at each rerun, all of the dimension that is most frequent among them."""
    rows = vectors.select("id", "v", F.xxhash64("id").alias("o")).orderBy("o", "id").limit(most).collect()
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    sizes, times = np.unique([len(row["v"]) for row in rows], return_counts=True)
    rows = [row for row in rows if len(row["v"]) == sizes[times.argmax()]]
    return np.array([row["id"] for row in rows], dtype=np.int64), matrix([bytes(row["v"]) for row in rows])
