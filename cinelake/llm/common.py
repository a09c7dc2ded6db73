"""Pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.session import checkpointed, shared_dir, stored

__all__ = ["checkpointed", "chunks", "crc_mod", "documents", "embeddings", "last_long", "lower_ascii", "shared_dir", "small_batches", "stored", "text_bytes", "tidied"]

#: Bytes of text that are worked on at a time; a longer text is taken by itself.
CHUNK = 2_000_000
#: Rows of an Arrow batch, at most, so that batches of long texts stay small.
BATCH = 1000
#: Stands for a null id where ids are compared, so that a row without an id comes last.
LAST = 2**63 - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of a column as text, modulo ``divisor``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def last_long(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))


def lower_ascii(column: Column) -> Column:
    """A-Z to lower case; no other character changes."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch in one array, and the n+1 offsets of the texts in it. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about CHUNK bytes of text: the rows, their bytes, and the offsets of the texts."""
    raw, at = text_bytes(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1)
        yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to Arrow batches of at most BATCH rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))
    return df


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives the memory that it took back to the system at its end: Python workers are used again by later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
