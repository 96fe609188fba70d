"""Query op3_mix. SQL can't express the draws; tests/llm computes every row's words from the draws by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mix import MixParams, plan, taken


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = plan(table(spark, sf_dir, "documents"), MixParams())
    return mix.scratch.settle(taken(mix).select("doc_id", "size", "source_size", "target", "taken"))


QUERIES = {"op3_mix": op3_mix}
ORACLE_SQL: dict[str, str] = {}
