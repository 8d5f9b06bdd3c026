"""The ingestion machine on a stream: keyed state with event-time timers for leases and for what is to be forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators import ingestion as M

STATE = "status string, holder string, until long, tries long, next long, since long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; set for the session before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Leases(StatefulProcessor):
    """One job's state and its timer: the end of the lease, or of a finished job's time."""

    def __init__(self, machine: M.Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _job(self) -> M.Job | None:
        if not self.state.exists():
            return None
        status, holder, until, tries, after, since = self.state.get()
        return M.Job(status, holder, until, int(tries), after, since)

    def _keep(self, job: M.Job | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job is None:
            self.state.clear()
            return
        self.state.update(tuple(job))
        due = job.until if job.holder is not None else job.since + self.machine.retention if job.status in M.FINAL else None
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))  # timers are milliseconds: never before the time

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        job, out = self._job(), []
        # a micro-batch has its events in any order, also across Arrow batches
        events = sorted(tuple(x) for batch in rows for x in batch[["us", "event", "asks", "worker", "wait_us"]].itertuples(index=False, name=None))
        for job, made in self.machine.walk(key[0], job, ((int(u), int(e), a, w, int(d)) for u, e, a, w, d in events)):  # noqa: B020
            out.append(made)
        self._keep(job)
        yield M.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now, job, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, self._job(), []
        if (after := self.machine.lapsed(job, now)) is not None:
            out.append(M.row(key[0], after.since, None, "expired", after))
            job = after
        elif self.machine.forgotten(job, now):
            job = None
        self._keep(job)
        yield M.frame(out)

    def close(self) -> None:
        pass


def stages(events: DataFrame, machine: M.Machine, late: str = "10 minutes") -> DataFrame:
    """The rows of ``operators.ingestion.stages`` for a stream of events (``events_of``); leases run out as the watermark passes them."""
    keyed_state(events.sparkSession)
    filled = events.withColumn("event", F.coalesce("event", F.lit(-1))).withColumn("worker", F.coalesce("worker", F.lit("")))
    timed = filled.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    return timed.groupBy("job").transformWithStateInPandas(Leases(machine), M.SCHEMA, "append", "eventtime")
