"""Query op12_packing. SQL has no tokenizer; tests/llm rebuilds every document from its pieces and compares costs with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import PackParams, packed

MODEL = "byte_bpe_50k.json"


def op12_packing(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    return packed(table(spark, sf_dir, "documents"), model_path, PackParams())


QUERIES = {"op12_packing": op12_packing}
ORACLE_SQL: dict[str, str] = {}
