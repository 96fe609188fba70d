"""Query op9_hmm. SQL has no Baum-Welch; tests/llm compares the base score and the recursion with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .hmm import HmmParams, score


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0, HmmParams())


QUERIES = {"op9_hmm": op9_hmm}
ORACLE_SQL: dict[str, str] = {}
