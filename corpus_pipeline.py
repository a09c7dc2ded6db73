"""A corpus pipeline of the training-data operators: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import bpe, jaccard, line_dedup, mixing, toxicity
from cinelake.llm.common import last_long, stored

#: Stages with trained models and hashed joins have no SQL; a test compares them with plain Python.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject.

    A null text is judged as an empty one. Each row is judged by its own text, with a null or repeated id, too; equal texts (ties) are
    judged alike, and very long ones whole. Without labels of both classes all rows stay. The rows' columns, whatever their names, pass
    as they are, nulls included. An empty table gives an empty one.
    """
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; ``n_chars`` is of the text that stays.

    Rows of one id are one document, rows without an id are one that comes last; a line that ties between ids stays in the smallest. A
    null or empty text becomes empty. Very long texts are split whole. No row is dropped; other columns, also those named ``n_lines`` or
    ``n_dropped``, pass as they are. An empty table gives an empty one.
    """
    kept = line_dedup.drop_repeats(docs)
    return kept.select(*[F.length("text").cast("long").alias(name) if name == "n_chars" else F.col(name) for name in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near copies.

    Each row is judged by its own text, whether its id is null or repeated or not; a null id is the largest. Of rows that tie, with the
    same id and the same text, one stays. Null and empty texts all stay. Very long texts are shingled whole. Other columns, whatever
    their names, pass as they are. An empty table gives an empty one.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")  # written, so that numbers stay
    groups = jaccard.link(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("id").alias("__row"), "component")
    named = rows.select("__row", last_long("doc_id").alias("__id")).join(groups, "__row")
    first = named.groupBy("component").agg(F.min(F.struct("__id", "__row")).alias("first")).select("first.__row")
    return rows.join(first.hint("shuffle_hash"), "__row", "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as many times as it is taken.

    Texts without words, null ones included, are never taken. A null source is a source of its own. Repeated rows, which tie, are taken
    alike. Other columns, whatever their names, pass as they are. An empty table gives an empty one.
    """
    taken = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), (F.col("taken") / F.col("size")).cast("int").alias("__times"))
    taken = taken.groupBy("__id", "__source", "__size").agg(F.max("__times").alias("__times"))  # repeated rows are taken alike
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (mixing.words(F.col("text")) == F.col("__size"))
    rows = docs.join(taken.hint("shuffle_hash"), same)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to.

    One row per row; a null text is empty and has no ids; null and repeated ids are returned as they are; very long texts are encoded
    whole; other columns are left out. An empty table gives an empty one.
    """
    return bpe.encode_decode(docs).select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("jaccard_join", near_copies), ("mixing", mixed), ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
