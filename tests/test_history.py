"""Status history in a stream: equal to the batch twin after a restart, redelivery and late events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.streaming import history as H

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, H.PROVIDER)
    yield spark
    spark.conf.set(name, old)


def run(spark, schema, log, at, keep_ms=None):
    """Takes what is new in the log; returns each id's newest record of this run."""
    got = {}

    def sink(batch, epoch):
        for r in batch.collect():
            if r.id not in got or (r.seq, len(r.history)) >= (got[r.id].seq, len(got[r.id].history)):
                got[r.id] = r

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
    if keep_ms is not None:
        stream = stream.withWatermark("at", "0 seconds")
    q = H.history_stream(stream, keep_ms).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return got


def test_history_is_the_batch_twin(rocks, tmp_path):
    e = rocks.read.parquet(f"{SF}/events.parquet")
    e = e.select((F.col("user_id") % 20).alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "inspector").otherwise("farmer").alias("role"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 5 == 0, "note").alias("note"))
    log = f"{tmp_path}/log"
    first, rest = e.where("seq % 2 = 0"), e.where("seq % 2 = 1 OR seq % 10 = 0")  # the second part brings old and repeated events
    first.repartition(2).write.mode("append").parquet(log)
    one = run(rocks, e.schema, log, f"{tmp_path}/c")
    rest.repartition(2).write.mode("append").parquet(log)
    got = one | run(rocks, e.schema, log, f"{tmp_path}/c")  # another query from the checkpoint
    want = {}
    for r in H.history(e.unionByName(first)).orderBy("id", "place").collect():
        want.setdefault(r.id, []).append(r)
    assert set(got) == set(want)
    for i, rows in want.items():
        g = got[i]
        assert [tuple(h[n] for n in H.NAMES) for h in g.history] == [tuple(r[n] for n in H.NAMES) for r in rows]
        assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and [r.current for r in rows] == [False] * (len(rows) - 1) + [True]
        assert (g.seq, g.status, g.role, g.at, g.note, g.approved) == (rows[-1].seq, rows[-1].status, rows[-1].role, rows[-1]["at"], rows[-1].note, rows[-1].role == "inspector")


def test_history_expires_but_the_record_stays(rocks, tmp_path):
    schema = "id long, seq long, role string, status string, at timestamp, note string"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    log = f"{tmp_path}/log"
    week = 7 * 24 * 3600 * 1000
    put = lambda *rows: rocks.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(log)
    put((1, 1, "farmer", "fixed", day(0), None), (1, 2, "inspector", "open", day(1), "again"))
    got = run(rocks, rocks.createDataFrame([], schema).schema, log, f"{tmp_path}/c", week)
    assert [h["status"] for h in got[1].history] == ["fixed", "open"] and got[1].approved
    put((2, 3, "farmer", "fixed", day(30), None))
    run(rocks, rocks.createDataFrame([], schema).schema, log, f"{tmp_path}/c", week)
    put((2, 4, "farmer", "fixed", day(31), None))
    run(rocks, rocks.createDataFrame([], schema).schema, log, f"{tmp_path}/c", week)
    put((1, 5, "farmer", "fixed", day(32), None))
    got = run(rocks, rocks.createDataFrame([], schema).schema, log, f"{tmp_path}/c", week)
    assert [h["seq"] for h in got[1].history] == [5] and got[1].status == "fixed" and not got[1].approved
    # an event from before the expiry no longer undoes the record
    put((1, 4, "inspector", "open", day(33), None))
    got = run(rocks, rocks.createDataFrame([], schema).schema, log, f"{tmp_path}/c", week)
    assert got[1].seq == 5 and [h["seq"] for h in got[1].history] == [4, 5]
