"""The event log as keyed state with its history: each point's current record, and all of its events in order.

State is a map from an event's number in the log to the event, so a redelivered or late event changes nothing that
came after it, and a restart from the checkpoint goes on where it was. With ``keep`` an id that the watermark has left
behind by so long drops its history by a timer; the record itself stays.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``): only the entries that a batch touches
are read for an update, and the others when a record is handed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "role string, status string, at timestamp, note string"
RECORD = "id long, status string, role string, at timestamp, note string, seq long, approved boolean, history array<struct<seq: long, role: string, status: string, at: timestamp, note: string>>"
NAMES = ("seq", "role", "status", "at", "note")


class History(StatefulProcessor):
    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getMapState("log", "seq long", EVENT)
        self.record = handle.getValueState("record", f"seq long, {EVENT}")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, latest = self.record.get() if self.record.exists() else None, None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                at = None if pd.isna(r.at) else r.at.to_pydatetime()
                event = (r.role, r.status, at, r.note)
                if not self.log.containsKey((int(r.seq),)):
                    self.log.updateValue((int(r.seq),), event)
                if last is None or r.seq > last[0]:
                    last = (int(r.seq), *event)
                if at is not None and (latest is None or at > latest):
                    latest = at
        if last is None:
            return
        self.record.update(last)
        if self.keep_ms is not None and latest is not None:
            due = int(pd.Timestamp(latest).timestamp() * 1000) + self.keep_ms
            timers = [int(t) for t in self.handle.listTimers()]
            if not timers or due > max(timers):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(due)
        log = sorted((int(k[0]), *v) for k, v in self.log.iterator())
        history = [dict(zip(NAMES, e, strict=True)) for e in log]
        yield pd.DataFrame({"id": [key[0]], "status": [last[2]], "role": [last[1]], "at": [last[3]], "note": [last[4]], "seq": [last[0]], "approved": [last[1] == "inspector"], "history": [history]})

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.log.clear()
        yield from ()

    def close(self) -> None:
        pass


def history_stream(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """RECORD: an update row for each id that a micro-batch touches. ``events``: id, seq, role, status, at, note; with a watermark on ``at`` if ``keep_ms`` is given."""
    e = events.select("id", *NAMES)
    return e.groupBy("id").transformWithStateInPandas(statefulProcessor=History(keep_ms), outputStructType=RECORD, outputMode="Update", timeMode="None" if keep_ms is None else "EventTime")


def history(events: DataFrame) -> DataFrame:
    """The batch twin, a row for each event: id, place (1, 2, ...), seq, role, status, at, note, current (it is the id's record). Events are known by their seq."""
    e = events.select("id", *NAMES).groupBy("id", "seq").agg(F.min(F.struct("role", "status", "at", "note")).alias("e")).select("id", "seq", "e.*")
    w = W.partitionBy("id").orderBy("seq")
    last = e.groupBy(F.col("id")).agg(F.max("seq").alias("last"))
    return e.withColumn("place", F.row_number().over(w)).join(last, "id").withColumn("current", F.col("seq") == F.col("last")).drop("last")
