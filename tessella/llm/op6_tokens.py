"""Query op6_tokens. SQL has no tokenizer; tests/llm compares with the library on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import token_counts

MODEL = "piece_bpe_32k.model"


def op6_tokens(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    return token_counts(table(spark, sf_dir, "documents"), model_path)


QUERIES = {"op6_tokens": op6_tokens}
ORACLE_SQL: dict[str, str] = {}
