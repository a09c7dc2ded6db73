"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

Each byte stands as one character (the usual printable stand-ins), each vocabulary entry is a piece whose score is minus its
rank, and normalisation is the identity. Sentencepiece then merges, within one pre-token, the neighbours whose joint piece has
the best score, which is the lowest rank: the merge rule of byte-level BPE. Nothing is trained.

Each text is handled by itself in the partition that holds it: no shuffle, and each task makes the
model from the vocabulary file, whose size is fixed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import documents, small_batches, tidied

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers once they have come again, and pre-tokens that it waits for to come again. Either memory is
#: emptied when it is full.
REMEMBERED, AWAITED = 200_000, 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """For each byte a printable character: itself where Latin-1 prints it, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto with piece id = rank, and the unknown piece after the last rank."""
    chars = byte_characters()
    by_rank = {rank: token for token, rank in ranks.items()}
    last = max(by_rank)
    out = bytearray()
    for rank in range(last + 1):
        if rank in by_rank:
            piece, kind = "".join(map(chars.__getitem__, by_rank[rank])), 1
        else:  # a gap in the ranks: an unused piece keeps ids equal to ranks
            piece, kind = f"{rank}", 5
        out += _field(1, _field(1, piece.encode()) + _field(2, float(-rank)) + _field(3, kind))
    out += _field(1, _field(1, b"\xee\x80\x81unk") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, last + 2) + _field(40, last + 1)  # BPE, size, id of the unknown piece
    for number in (41, 42, 43):  # no begin, end or padding piece
        trainer += _varint(number << 3) + b"\xff" * 9 + b"\x01"
    trainer += _field(45, b"\xee\x80\x81unk")
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec(dict):
    """Encodes and decodes texts with one vocabulary. As a mapping: from a pre-token to its packed ids."""

    def __init__(self, path: str, pattern: str) -> None:
        import sentencepiece

        self.ranks = read_ranks(path)
        chars = byte_characters()
        self.table = dict(enumerate(chars))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.find = regex.compile(pattern).findall
        self.awaited: dict[str, bytes] = {}
        back = {c: b for b, c in enumerate(chars)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for rank in self.ranks.values():
            self.pieces[rank] = bytes(map(back.__getitem__, self.model.id_to_piece(rank)))

    def __missing__(self, token: str) -> bytes:
        """A pre-token that is an entry as a whole is that entry; any other is merged by the model."""
        packed = self.awaited.pop(token, None)
        if packed is not None:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = packed
            return packed
        raw = token.encode()
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.model.encode(raw.decode("latin-1").translate(self.table), out_type=int)
        packed = np.array(ids, dtype="<u4").tobytes()
        if len(token) < 64:
            if len(self.awaited) >= AWAITED:
                self.awaited.clear()
            self.awaited[token] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.find(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text and the bytes that they decode to.

    Returns one row per input row, in any order: ``id_column``, ``ids`` (little-endian unsigned 32-bit integers, binary),
    ``n_tokens`` (long) and ``decoded`` (binary). A null or empty text has no ids. Null and repeated ids are returned as they
    are; other columns are ignored. An empty table gives an empty result.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                ids = [own.encode(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([own.decode(x) for x in ids], pa.binary())], names=["id", "ids", "n_tokens", "decoded"])

    rows = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "id long, ids binary, n_tokens long, decoded binary").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document the number of ids and the SHA-256 of ids and decoded bytes."""
    return encode_decode(docs, path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
