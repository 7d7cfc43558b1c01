"""What streams have done over their whole life: batches, rows, and rows that came too late.

A query keeps its latest progress reports only, and none over a restart. A ledger listens to all of them, adds
them up, and appends each as an event to a folder of JSON lines, from which the counters of any number of
runs come back as a table.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: The fields that every event has, whatever else it carries.
CORE = ("ts", "schemaVersion", "event", "runId", "roomId", "step", "status", "elapsedMs")
EVENT = "ts string, schemaVersion string, event string, runId string, roomId string, step string, status string, elapsedMs long, queryId string, batchId long, rows long, dropped long, error string"
VERSION = "1.0"
#: Events held before they are written.
HELD = 256


def dropped_rows(progress: object) -> int:
    return sum(int(s.numRowsDroppedByWatermark or 0) for s in progress.stateOperators)


class Ledger(StreamingQueryListener):
    """Counters of every query of a session, from the time at which it was added to it; see watch()."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.counts: dict[str, dict[str, int]] = {}
        self.events: list[dict] = []
        self.ended: set[str] = set()
        self.lock = threading.Condition()

    def note(self, event: str, query: object, status: str | None = None, elapsed: int | None = None, step: str | None = None, **more: object) -> None:
        row = dict.fromkeys(x.split()[0] for x in EVENT.split(", "))
        row |= {"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "schemaVersion": VERSION, "event": event, "runId": str(query.runId), "queryId": str(query.id), "step": step, "status": status, "elapsedMs": elapsed, **more}
        self.events.append(row)

    def onQueryStarted(self, event: object) -> None:
        with self.lock:
            self.counts.setdefault(str(event.id), {"runs": 0, "batches": 0, "rows": 0, "dropped": 0})["runs"] += 1
            self.note("stream.start", event, "running", step=event.name)

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        with self.lock:
            count = self.counts.setdefault(str(p.id), {"runs": 0, "batches": 0, "rows": 0, "dropped": 0})
            dropped, rows = dropped_rows(p), int(p.numInputRows)
            count["batches"] += 1
            count["rows"] += rows
            count["dropped"] += dropped
            self.note("stream.batch", p, "ok", int(p.batchDuration), p.name, batchId=p.batchId, rows=rows, dropped=dropped)
            full = len(self.events) >= HELD
        if full:
            self.flush()

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        with self.lock:
            self.note("stream.end", event, "failed" if event.exception else "ok", error=event.exception)
            self.ended.add(str(event.runId))
            self.lock.notify_all()

    def totals(self, query: StreamingQuery, timeout: float = 30.0) -> dict[str, int]:
        """runs, batches, rows and dropped of a query; of an ended one, once its last report has come."""
        with self.lock:
            if not query.isActive:
                self.lock.wait_for(lambda: str(query.runId) in self.ended, timeout)
            return dict(self.counts.get(str(query.id), {"runs": 0, "batches": 0, "rows": 0, "dropped": 0}))

    def flush(self) -> None:
        """Appends the events so far to the folder, as JSON lines; a file each time, whole or absent."""
        with self.lock:
            events, self.events = self.events, []
        if events and self.path:
            lines = [(json.dumps(e, ensure_ascii=False),) for e in events]
            self.spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(self.path)

    def close(self) -> None:
        self.spark.streams.removeListener(self)
        self.flush()


def watch(spark: SparkSession, path: str | None = None) -> Ledger:
    """A ledger of all queries that start in the session from now on, appending events to a folder if one is given; close() ends it."""
    ledger = Ledger(spark, path)
    spark.streams.addListener(ledger)
    return ledger


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def life(events: DataFrame) -> DataFrame:
    """(query_id, runs, batches, rows, dropped, failed) of event rows; a batch that ran again after a restart counts once, by its last report."""
    batch = events.where("event = 'stream.batch'").groupBy("queryId", "batchId").agg(F.max(F.struct("ts", "rows", "dropped")).alias("last"))
    sums = batch.groupBy("queryId").agg(F.count(F.lit(1)).alias("batches"), F.sum("last.rows").alias("rows"), F.sum("last.dropped").alias("dropped"))
    runs = events.groupBy("queryId").agg(F.count_distinct(F.when(F.col("event") == "stream.start", F.col("runId"))).alias("runs"), F.count_if((F.col("event") == "stream.end") & (F.col("status") == "failed")).alias("failed"))
    return runs.join(sums, "queryId", "left").fillna(0).select(F.col("queryId").alias("query_id"), "runs", "batches", "rows", "dropped", "failed")


def event_rows(rows: DataFrame, event: str | Column, **fields: object) -> DataFrame:
    """Rows as events with their core fields (null where neither rows nor fields have them); all else goes along as extra fields."""
    if isinstance(event, str) and not event:
        raise ValueError("an event needs a name")
    known = {"event": event if isinstance(event, Column) else F.lit(event), "schemaVersion": F.lit(VERSION), "ts": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    known |= {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
    core = [known.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast("long" if c == "elapsedMs" else "string").alias(c) for c in CORE]
    extra = [F.col(c) for c in rows.columns if c not in CORE] + [known[c].alias(c) for c in known if c not in CORE]
    return rows.select(*core, *extra)


def run_id() -> str:
    return uuid.uuid4().hex
