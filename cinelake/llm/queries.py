"""The queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinelake.llm import ann, bpe, embedding_dedup, jaccard, language, licenses, line_dedup, mixing, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_toxicity": toxicity.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_mixing": mixing.query,
    "op5_line_dedup": line_dedup.query,
    "op6_jaccard_join": jaccard.query,
    "op7_license_scan": licenses.query,
    "op8_language_id": language.query,
    "op9_byte_bpe": bpe.query,
    "op10_ann": ann.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op6_jaccard_join": jaccard.ORACLE_SQL,
}
