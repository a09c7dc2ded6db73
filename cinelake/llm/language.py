"""Language identification by compression: the language whose dictionary makes a text smallest wins.

For each language a raw-content dictionary is put together from a bounded number of labelled texts. A text is compressed by zstandard
once with each dictionary, in blocks so that a long text does not become its own dictionary; the language with the smallest total is
chosen, and the choice is marked as rejected where the next best is nearly as small.

A dictionary has at most ``DICTIONARY`` bytes, what zstandard looks back at. Of the at most ``ROWS`` texts a language, the shorter
ones are taken whole, and of the others, which would not all fit, equal shares in pieces that are spread evenly over the whole text.
Prediction is a map over partitions without a shuffle; what each task is sent is one dictionary for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinelake.llm.common import crc_mod, documents

#: Labelled texts that are learned from for each language, at most.
ROWS = 200
#: Bytes of a dictionary, at most.
DICTIONARY = 64_000
#: Bytes of a piece of a text that does not fit whole.
PIECE = 400
#: Bytes compressed at a time.
BLOCK = 4_000
LEVEL = 9
#: Choices whose relative margin is less are marked as rejected.
MARGIN = 0.01
UNKNOWN = "und"


def learn(docs: DataFrame, learnable: Column, rows: int = ROWS) -> dict[str, bytes]:
    """A dictionary for each non-null ``lang`` among the rows where ``learnable`` holds, from the ``rows`` rows with least id hash.

    Rows with a null id, lang or text are not learned from. Rows of a repeated id are texts of their own, in order of text, as far as
    ``rows`` goes. An empty table gives no dictionaries."""
    ids = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id")).where("id is not null")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    some = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows).select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = texts.where("lang is not null and text is not null").join(F.broadcast(some), "id", "left_semi")  # at most `rows` ids a language

    def build(table: pa.Table) -> pa.Table:
        texts = sorted(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True))[:rows]
        whole = b"".join(shares([text.lower().encode() + b"\n" for _, text in texts]))
        return pa.table({"lang": [table.column("lang")[0].as_py()], "dictionary": pa.array([whole], pa.binary())})

    return {row["lang"]: bytes(row["dictionary"]) for row in found.groupBy("lang").applyInArrow(build, "lang string, dictionary binary").collect()}


def shares(texts: list[bytes], room: int | None = None) -> list[bytes]:
    """Of each text what it gives to a dictionary of ``room`` bytes (DICTIONARY): all of it where it is no longer than its share, else
    evenly spaced pieces of it. What short texts leave goes to the longer ones."""
    room = DICTIONARY if room is None else room
    out: dict[int, bytes] = {}
    for done, k in enumerate(sorted(range(len(texts)), key=lambda k: len(texts[k]))):
        share, text = room // (len(texts) - done), texts[k]
        if len(text) > share:
            n = max(1, share // PIECE)
            size = share // n
            text = b"".join(text[at : at + size] for at in ((len(text) - size) * j // max(1, n - 1) for j in range(n)))
        out[k] = text
        room -= len(text)
    return [out[k] for k in range(len(texts))]


class Judge:
    """Compressors by language, in the order of the languages' names."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = sorted(dictionaries)
        self.compressors = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, relative margin to the next best, and whether that is too narrow."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        raw = text.lower().encode()
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        sizes = np.array([sum(map(len, map(compress, blocks))) for compress in self.compressors], dtype=np.float64)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        margin = 1 - sizes[best] / np.delete(sizes, best).min()
        return self.names[best], float(margin), bool(margin < MARGIN)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id_column``, ``lang_pred``, ``score`` (0 to 1, the relative margin) and ``rejected`` (boolean).

    ``lang_pred`` is ``und``, with score 0 and rejected, where the text is null, empty or has no letter, or where nothing was
    learned; a rejected choice still names its language. Ties go to the first name. Null and repeated ids are returned as they
    are, other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries)
        for batch in batches:
            found = [judge(text) for text in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return predict(docs, learn(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
