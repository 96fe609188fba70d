"""Helpers that the training-data operators share: tables, columns, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components, hot_rows, join_unique, with_least
from ..scratch import BROADCAST_BYTES, Scratch

__all__ = ["ARROW_BYTES", "BROADCAST_BYTES", "SPACES", "Scratch", "components", "crc_mod", "held", "hot_rows", "join_unique", "lean_batches", "table", "with_least", "words_of"]

#: Words are maximal runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


#: Bytes of an Arrow batch for Python; Spark's own limit is 64 MB, of which each task holds several copies outside the heap.
ARROW_BYTES = 4 << 20


def lean_batches(spark: SparkSession) -> None:
    """Batches of texts are bounded by bytes, in the session; a smaller limit that is set there stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: operators never see extra columns, whatever they are called."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words_of(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
