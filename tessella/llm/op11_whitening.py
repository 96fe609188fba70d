"""Query op11_whitening. SQL has no eigenvectors; tests/llm compares with brute force in exact and double arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .whitening import WhiteningParams, whitened


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # exact in the operator; null here beyond a long
    return whitened(table(spark, sf_dir, "embeddings"), WhiteningParams()).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLE_SQL: dict[str, str] = {}
