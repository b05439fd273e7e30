"""Operator 1, token counts: byte-pair merging with a heap and a linked list; only counts, no identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from reckon.llm import bpe
from reckon.llm.common import parquet, texts


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of a text column under a word-end byte-pair vocabulary; null counts as empty, so 0.

    path: vocabulary file, present on every executor (default: the installed public one). Texts are whole; memory
    is one Arrow batch and a bounded chunk cache.
    """

    @F.pandas_udf(LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = bpe.word_bpe(path or bpe.default_path())
        for batch in batches:
            yield pd.Series([0 if t is None else model.count(t) for t in batch], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    Null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows are kept as they are; other columns
    are ignored; an empty table gives an empty result. No shuffle.
    """
    return (
        texts(docs, id_col, text_col)
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), count_tokens(F.col("text"), path).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(parquet(spark, sf_dir, "documents"))
