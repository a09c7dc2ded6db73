"""Line deduplication across documents with two Bloom filters.

1. Each task hashes the keys of its lines and sends the hashes that it has seen in one document and in more, each once, to the
   segment of the filter that they belong to: eight bytes a distinct line.
2. The owner of a segment streams them into two Bloom filters: a hash whose bits are all set in the first (seen once) goes to the
   second (seen twice). The second filter, of fixed size, is broadcast.
3. Only lines whose hash the second filter holds are suspected; only their digests are shuffled, and confirmed exactly: a digest
   held by two documents or more is a repeat, and the smallest id that holds it keeps it.

The filters have PER_LINE bits for each line, rounded up to a power of two, and at most 2 ** MOST bits, so that what is broadcast has
a bound. Beyond it (some 130 million lines) more lines are suspected and shuffled; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import documents, last_long, small_batches, stored, tidied

SPACE = " \t\n\x0b\x0c\r"
#: Code points that a key must have.
LEAST = 10
#: Bits of each filter for a line of the table, and the least and the most bits of a filter as powers of two (128 MB).
PER_LINE, FEWEST, MOST = 8, 20, 30
#: Hashes that a task gathers before it sends them on.
GATHERED = 400_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def line_key(line: str) -> bytes | None:
    """The key of a line, or None where it is too short to count."""
    key = line.strip(SPACE)
    return key.encode().lower() if len(key) >= LEAST else None  # bytes.lower() changes A-Z alone


@dataclass(frozen=True)
class Size:
    """Filters of 2 ** ``bits`` bits, in segments of at most 2 ** 21 by the first bits of a hash."""

    bits: int

    @property
    def head(self) -> int:
        return max(6, self.bits - 21)

    @property
    def inner(self) -> int:
        return self.bits - self.head

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.head)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash its three bits within its segment."""
        return (hashes[None, :] * _MIX[:, None]) >> np.uint64(64 - self.inner)


def filter_size(docs: DataFrame) -> Size:
    """From the number of lines of all texts, which is no less than that of distinct keys."""
    text = F.col("text").cast("string")
    lines = docs.agg(F.sum(1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))).first()[0] or 0
    return Size(min(MOST, max(FEWEST, (PER_LINE * lines).bit_length())))


def _sent(size: Size, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once, twice = set(), set()

    def flush() -> pa.RecordBatch:
        a, b = (np.sort(np.fromiter(x, np.uint64, len(x))) for x in (once - twice, twice))
        cuts = np.arange(1, 1 << size.head, dtype=np.uint64) << np.uint64(64 - size.head)
        rows = [(k, x.tobytes(), y.tobytes()) for k, (x, y) in enumerate(zip(np.split(a, np.searchsorted(a, cuts)), np.split(b, np.searchsorted(b, cuts)), strict=True)) if len(x) or len(y)]
        once.clear()
        twice.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["segment", "once", "twice"])

    for batch in batches:
        for text in batch.column(0):
            keys = {k for k in map(line_key, (text.as_py() or "").split("\n")) if k is not None}
            own = set(map(xxhash.xxh3_64_intdigest, keys))
            twice |= own & once
            once |= own
            if len(once) > GATHERED:
                yield flush()
    if once:
        yield flush()


def _filtered(size: Size, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter of each segment of a partition, packed and compressed."""
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            first, second = filters.setdefault(segment, (np.zeros(1 << size.inner, dtype=bool), np.zeros(1 << size.inner, dtype=bool)))
            places = size.places(np.frombuffer(once, dtype=np.uint64))
            again = first[places].all(axis=0)
            second[places[:, again]] = True
            first[places] = True
            places = size.places(np.frombuffer(twice, dtype=np.uint64))
            first[places] = second[places] = True
    compress = zstandard.ZstdCompressor().compress
    for segment, (_, second) in filters.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([compress(np.packbits(second).tobytes())], pa.binary())], names=["segment", "bits"])


def seen_twice(docs: DataFrame, size: Size) -> dict[int, bytes]:
    """The second filter by segment: compressed bits of all hashes that more than one document holds, and few others."""
    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(partial(_sent, size)), "segment long, once binary, twice binary")
    parts = sent.repartition(1 << min(size.head, 8), "segment").mapInArrow(tidied(partial(_filtered, size)), "segment long, bits binary")
    return {row["segment"]: bytes(row["bits"]) for row in parts.collect()}  # at most 2 ** MOST bits


def repeats(docs: DataFrame) -> DataFrame:
    """The lines to drop: ``id`` (long, a null doc_id as the largest), ``th`` (hash of the text) and ``digests`` (array of binary, one
    for each key), so that no row holds more than the keys of one text."""
    size = filter_size(small_batches(docs))
    shared = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, size))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        bits = np.zeros((1 << size.head, (1 << size.inner) // 8), dtype=np.uint8)
        for segment, packed in shared.value.items():
            bits[segment] = np.frombuffer(decompress(packed), dtype=np.uint8)
        for batch in batches:
            owner, keys = [], []
            for k, text in enumerate(batch.column(2)):
                own = {x for x in map(line_key, (text.as_py() or "").split("\n")) if x is not None}
                owner += [k] * len(own)
                keys += own
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            segment, places = size.segment(hashes), size.places(hashes).astype(np.int64)
            held = np.flatnonzero((bits[segment, places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).all(axis=0)).tolist()
            rows = pa.array([owner[k] for k in held], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([blake2b(keys[k], digest_size=16).digest() for k in held], pa.binary())], names=["id", "th", "digest"])

    rows = docs.select(last_long("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    suspects = stored(rows.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(tidied(suspected), "id long, th long, digest binary"), "line-suspects")
    # written before it is met, so that Spark can split a digest that very many documents hold
    first = stored(suspects.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"), "line-repeats")
    later = suspects.join(first, "digest").where("id != first")
    return later.groupBy("id", "th").agg(F.collect_set("digest").alias("digests"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, ``text`` without its dropped lines, and ``n_lines``, ``n_dropped`` (long) added.

    A key held by at least two different ids loses all its lines except in the smallest id. Rows of the same id are one document;
    rows without an id count as one document that comes last. A null or empty text is one empty line and becomes empty. Any other
    column, also one named as those added, is passed on or replaced. An empty table gives an empty result.
    """
    names = docs.columns
    marks = repeats(docs).withColumnsRenamed({"id": "__id", "th": "__th", "digests": "__digests"})
    keyed = docs.withColumns({"__key": last_long("doc_id"), "__hash": F.xxhash64(F.col("text").cast("string"))})
    joined = keyed.join(marks.hint("shuffle_hash"), (F.col("__key") == F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    kept = [name for name in names if name not in ("n_lines", "n_dropped")]
    rows = joined.select(*[F.col(f"`{name}`") for name in kept], "__digests").withColumn("text", F.col("text").cast("string"))
    text = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts, lines, dropped = [], [], []
                for whole, digests in zip(part.column(text), part.column(len(kept)), strict=True):
                    own = (whole.as_py() or "").split("\n")
                    lines.append(len(own))
                    if digests.is_valid:
                        gone = set(digests.as_py())
                        own = [x for x in own if (key := line_key(x)) is None or blake2b(key, digest_size=16).digest() not in gone]
                    dropped.append(lines[-1] - len(own))
                    texts.append("\n".join(own))
                columns = [pa.array(texts, pa.string()) if k == text else part.column(k) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*kept, "n_lines", "n_dropped"])

    schema = rows.drop("__digests").schema.add("n_lines", "long").add("n_dropped", "long")
    return rows.mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, coalesce(k.doc_id <> r.keeper, false) AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
