"""Query op1_language. SQL has no learner; tests/llm measures held-out accuracy and compares the recursions with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .crf import CrfParams, fit, predict, sample


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = table(spark, sf_dir, "documents"), CrfParams()
    out = predict(docs, fit(*sample(docs, p), p))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language": op1_language}
ORACLE_SQL: dict[str, str] = {}
