"""Streams give what the batch twins give."""

from pyspark.sql import functions as F

from tessella.operators import sequences
from tessella.streaming import events as E

SF = "/root/testdata/sf0.001"


def test_fold(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "inspector").otherwise("farmer").alias("role"), F.col("event_type").alias("status"))
    e.orderBy(F.desc("seq")).repartition(4).write.parquet(f"{tmp_path}/log")  # arrival is not the log's order
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    q = E.fold_stream(stream).writeStream.outputMode("update").foreachBatch(E.upsert_sink(f"{tmp_path}/state", order="events")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(240)
    state = E.current(spark, f"{tmp_path}/state", E.OUT)
    got = sorted((r["id"], r["status"], r["events"], r["approved"]) for r in state.collect())
    want = sorted((r["id"], r["status"], r["events"], r["approved"]) for r in sequences.fold_events(e, "id", ["seq"], "status", "role").collect())
    assert got == want


def test_upserts(spark, tmp_path):
    """Skipped and redelivered epochs, old news and untouched buckets."""
    at = f"{tmp_path}/s"
    schema = "id long, seq long, status string"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    write = E.upsert_sink(at, buckets=4)
    write(batch((1, 1, "a"), (2, 1, "b"), (3, 1, "c")), 0)
    write(batch((1, 3, "d")), 4)
    write(batch((1, 3, "d")), 4)
    write(batch((1, 2, "late"), (4, 1, "e")), 5)
    types = batch((0, 0, "")).schema
    assert sorted(tuple(r) for r in E.current(spark, at, types).select("id", "seq", "status").collect()) == [(1, 3, "d"), (2, 1, "b"), (3, 1, "c"), (4, 1, "e")]
    for k in range(6, 12):
        write(batch(*[(i, k, "z") for i in range(40)]), k)
    assert {p.name for p in (tmp_path / "s").glob("v*")} == {"v10", "v11"}
    assert E.current(spark, f"{tmp_path}/none", types).count() == 0


def test_windows(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/events")
    for name, f in (("tumbling", E.tumbling), ("sliding", E.sliding)):
        stream = E.event_stream(spark, f"{tmp_path}/events", table.schema)
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(240)
        batch = f(table.withColumn("ts", F.col("ts").cast("timestamp")))
        key = lambda d: sorted((r["start"], r["event_type"], r["n"], round(r["value"], 6)) for r in d.collect())
        assert key(spark.table(name)) == key(batch)
    stream = E.event_stream(spark, f"{tmp_path}/events", table.schema)
    q = E.sessions(stream).writeStream.outputMode("append").format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination(240)
    every = {(r["start"], r["user_id"], r["n"]) for r in E.sessions(table.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    got = {(r["start"], r["user_id"], r["n"]) for r in spark.table("sess").collect()}
    assert got <= every  # sessions still open stay in state
