"""Job states: queued, running, then done, failed or cancelled. The same transitions from a whole table and from a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The status that an event leads to, the statuses it may come from, those that end a job, finished jobs that are kept.
TARGET = {"queued": "queued", "started": "running", "done": "done", "failed": "failed", "cancelled": "cancelled"}
LEGAL = {"queued": {None}, "started": {"queued"}, "done": {"running"}, "failed": {"running"}, "cancelled": {"queued", "running"}}
FINISHED = ["done", "failed", "cancelled"]
MOST_FINISHED = 200

SCHEMA = "job long, event_id long, ts timestamp, event string, from_status string, to_status string, legal boolean"


def _key() -> Column:
    return F.struct("ts", "event_id")


def transitions(events: DataFrame) -> DataFrame:
    """job, event_id, ts, event, from_status, to_status, legal of every event: one that its job's status does not allow changes nothing.

    events: job, event_id (a key of the job), ts, event. In order of (ts, event_id) the first queued event opens a job; the first
    start after it runs it, unless it was cancelled; the first end after that (or the first cancellation) closes it. Whether
    these came before is told by running values over the job's events: one shuffle by job and two sorts that may spill, no
    table of jobs and no joins. Other events (drained) change no status and are legal at any time; those with a null job, id,
    time or name are left out, repeated ones are one (the first by time).
    """
    e = events.select("job", "event_id", "ts", "event").where("job is not null and event_id is not null and ts is not null and event is not null").repartition("job")
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy("job", "event_id").orderBy("ts", "event"))).where("_n = 1").drop("_n")
    before = Window.partitionBy("job").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    came = lambda test: F.coalesce(F.max(test).over(before), F.lit(False))
    event, opened, running = F.col("event"), F.col("_opened"), F.col("_running")
    e = e.withColumn("_opened", came(event == "queued"))
    e = e.withColumn("_running", came(opened & (event == "started")))
    ends = (running & event.isin("done", "failed")) | (opened & (event == "cancelled"))
    e = e.withColumn("_closed", F.first(F.when(ends, event), ignorenulls=True).over(before))
    closed = F.col("_closed")
    status = F.coalesce(closed, F.when(running, "running").when(opened, "queued"))
    moves = ((event == "queued") & ~opened) | (closed.isNull() & (((event == "started") & opened & ~running) | ends))
    target = F.coalesce(*[F.when(event == name, after) for name, after in TARGET.items()])
    named = event.isin(*TARGET)
    return e.select("job", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event", status.alias("from_status"), F.when(moves, target).otherwise(status).alias("to_status"), (moves | ~named).alias("legal"))


def statuses(moved: DataFrame) -> DataFrame:
    """job, status, since, events, illegal, undrained (whether an event came after the last drained one), from transitions()."""
    key, is_drain = _key(), F.col("event") == "drained"
    last = F.max(F.when(F.col("legal") & F.col("event").isin(*TARGET), F.struct("ts", "event_id", "to_status")))
    g = moved.groupBy("job").agg(last.alias("l"), F.count("*").alias("events"), F.count_if(~F.col("legal")).alias("illegal"), F.max(F.when(is_drain, key)).alias("d"), F.max(F.when(~is_drain, key)).alias("o"))
    return g.select("job", F.col("l.to_status").alias("status"), F.col("l.ts").alias("since"), F.col("l.event_id").alias("by_event"), "events", "illegal", F.coalesce(F.col("o") > F.col("d"), F.col("o").isNotNull()).alias("undrained"))


def retained(jobs: DataFrame, most: int = MOST_FINISHED) -> DataFrame:
    """The jobs (of statuses()) that are kept: those not finished, the first so many that finished, and any with undrained events."""
    over = F.col("status").isin(*FINISHED)
    first = jobs.where(over).orderBy("since", "by_event", "job").limit(most).select("job", F.lit(True).alias("_first"))  # the rule's limit
    return jobs.join(first, "job", "left").where(~F.coalesce(over, F.lit(False)) | F.col("undrained") | F.col("_first")).drop("_first")


class JobStates(StatefulProcessor):
    """transitions() of a stream grouped by job. A batch's events of a job are taken in order of (ts, event_id); what comes in a later batch is later.

    With silent_ms a job that is not finished fails that long (in event time) after its last transition, by an event named
    timeout with the id of that transition.
    """

    def __init__(self, silent_ms: int | None = None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, event_id long")
        self.timer = handle.getValueState("timer", "at long")

    def _now(self) -> str | None:
        return self.status.get()[0] if self.status.exists() else None

    def _set(self, status: str, event_id: int, ms: int) -> None:
        self.status.update((status, event_id))
        if self.silent_ms is None:
            return
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if status not in FINISHED:
            self.handle.registerTimer(ms + self.silent_ms)
            self.timer.update((ms + self.silent_ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        taken = pd.concat([r[["event_id", "ts", "event"]] for r in rows]).drop_duplicates("event_id").sort_values(["ts", "event_id"])
        out = []
        for event_id, ts, event in taken.itertuples(index=False):
            before = self._now()
            moves = event in LEGAL and before in LEGAL[event]
            after = TARGET[event] if moves else before
            if moves:
                self._set(after, int(event_id), int(ts.timestamp() * 1000))
            out.append((key[0], event_id, ts, event, before, after, moves or event not in LEGAL))
        yield pd.DataFrame(out, columns=["job", "event_id", "ts", "event", "from_status", "to_status", "legal"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, at = self._now(), expiredTimerInfo.getExpiryTimeInMs()
        event_id = self.status.get()[1]
        self.timer.clear()
        self.status.update(("failed", event_id))
        yield pd.DataFrame([(key[0], event_id, pd.Timestamp(at, unit="ms"), "timeout", before, "failed", True)], columns=["job", "event_id", "ts", "event", "from_status", "to_status", "legal"])

    def close(self) -> None:
        pass


def streamed(events: DataFrame, silent_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """transitions() of a streaming DataFrame, in append mode. Its session needs the RocksDB state store."""
    rows = events.select(F.col("job").cast("long").alias("job"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "event").where("job is not null and event_id is not null and ts is not null and event is not null")
    mode = "None"
    if silent_ms is not None:
        rows, mode = rows.withWatermark("ts", late), "EventTime"
    return rows.groupBy("job").transformWithStateInPandas(JobStates(silent_ms), outputStructType=SCHEMA, outputMode="Append", timeMode=mode)
