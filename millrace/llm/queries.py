"""Queries p6 to p8 over documents and eval_items."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import leakage, sentences, tokenizer
from millrace.session import table

#: Folder of the public tokenizers; the environment may name another.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
SLOP = 4


def p6_ids(spark: SparkSession, d: str, folder: str = TOKENIZERS) -> DataFrame:
    rank_file = os.path.join(folder, "byte_bpe_50k.tiktoken")
    return tokenizer.encode(table(spark, d, "documents"), "doc_id", "text", rank_file)


def p6_multi_ids(spark: SparkSession, d: str, folder: str = TOKENIZERS) -> DataFrame:
    """The same operator with the vocabulary for many languages."""
    rank_file = os.path.join(folder, "byte_bpe_multi_50k.tiktoken")
    return tokenizer.encode(table(spark, d, "documents"), "doc_id", "text", rank_file)


def _matches(spark: SparkSession, d: str, slop: int | None = None) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leakage.matches(docs, "doc_id", "text", items, "item_id", "prompt", slop)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_matches(spark, d)).select("doc_id", "item_id").distinct()


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that share a run of words exactly or nearly, with how much of the item they cover."""
    return _matches(spark, d, SLOP)


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"), "doc_id", "text", "cells")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_sentences(spark, d).select("doc_id", "char_start", F.col("char_end").cast("bigint").alias("char_end"))


def queries() -> dict:
    return {
        "p6_ids": p6_ids, "p6_multi_ids": p6_multi_ids,
        "p7_found": p7_found, "p7_matches": p7_matches,
        "p8_found": p8_found, "p8_sentences": p8_sentences,
    }


def oracle_sql() -> dict[str, str]:
    """None of the three can be written in SQL; tests hold them against other implementations."""
    return {}
