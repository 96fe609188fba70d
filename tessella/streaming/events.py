"""Streaming twins: the event log as keyed state, and event-time windows with watermarks.

The log's order is its sequence column, not arrival: state keeps the largest sequence seen, so late or repeated
events never undo a later one. Event-time windows are additions of this library.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

OUT = "id long, status string, role string, seq long, events long, approved boolean"
STATE = "status string, role string, seq long, events long"


def _fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, role, seq, events = state.get if state.exists else (None, None, -1, 0)
    for pdf in batches:
        events += len(pdf)
        top = pdf.loc[pdf["seq"].idxmax()]
        if top["seq"] > seq:
            status, role, seq = top["status"], top["role"], int(top["seq"])
    state.update((status, role, seq, events))
    yield pd.DataFrame({"id": [key[0]], "status": [status], "role": [role], "seq": [seq], "events": [events], "approved": [role == "inspector"]})


def fold_stream(events: DataFrame) -> DataFrame:
    """Last event wins: an update row for each id that a micro-batch touches. ``events``: id, seq, role, status."""
    return events.select("id", "seq", "role", "status").groupBy("id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: str = "id", order: str = "seq", keep: int = 2, buckets: int = 64):
    """foreachBatch function that keeps one row a key, the newest, in versioned Parquet folders ``v<epoch>/bucket=<n>``.

    A version holds the buckets that its batch touched; the state is each bucket's newest version (``current``). A batch
    builds on the versions before it, whichever there are, so skipped epochs lose nothing and a redelivered batch gives
    the same version again. Versions that no bucket needs are deleted, but for the last ``keep``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        b = batch.withColumn("bucket", bucket).persist()
        try:
            touched = {r["bucket"] for r in b.select("bucket").distinct().collect()}  # ``buckets`` rows at most
            newest = _newest(spark, path, epoch - 1)
            known = _read(spark, path, {k: v for k, v in newest.items() if k in touched}, batch.schema)
            every = b.unionByName(known.withColumn("bucket", bucket))
            names = [c for c in batch.columns if c != key]
            rows = every.groupBy("bucket", key).agg(F.max_by(F.struct(*names), order).alias("row")).select(key, "row.*", "bucket")
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{epoch}")
        finally:
            b.unpersist()
        needed = set(_newest(spark, path, epoch).values()) | set(_versions(spark, path)[-keep:])
        for v in _versions(spark, path):
            if v not in needed:
                at, fs = _fs(spark, f"{path}/v{v}")
                fs.delete(at, True)

    return write


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Epochs written to the end."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v")]
    return sorted(int(p.getName()[1:]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _newest(spark: SparkSession, path: str, epoch: int) -> dict[int, int]:
    """The last version of each bucket, up to an epoch."""
    out = {}
    for v in _versions(spark, path):
        if v <= epoch:
            at, fs = _fs(spark, f"{path}/v{v}")
            for s in fs.listStatus(at):
                if s.getPath().getName().startswith("bucket="):
                    out[int(s.getPath().getName()[7:])] = v
    return out


def _read(spark: SparkSession, path: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    """Buckets of these versions, as one table."""
    out = spark.createDataFrame([], schema)
    for v in sorted(set(versions.values())):
        files = [f"{path}/v{v}/bucket={k}" for k, of in sorted(versions.items()) if of == v]
        out = out.unionByName(spark.read.option("basePath", f"{path}/v{v}").schema(schema).parquet(*files).select(*schema.names))
    return out


def current(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows that an ``upsert_sink`` holds."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _read(spark, path, _newest(spark, path, 1 << 62), schema)


def event_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """Parquet files as a stream, ``files`` a trigger; event time as TIMESTAMP, which a watermark needs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return _counted(events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type"))


def sliding(events: DataFrame, size: str = "6 hours", step: str = "3 hours", late: str = "1 hour") -> DataFrame:
    return _counted(events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return _counted(events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id"))


def _counted(grouped) -> DataFrame:
    out = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])
