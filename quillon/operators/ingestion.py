"""The life of an ingestion job: queued, leased to a worker, refreshed, expired, retried after a delay, ready or failed.

A job's events are walked in order of time by one small state machine; ``stages`` walks whole tables, ``streaming.ingestion`` walks streams
with the same machine, where timers find what the next event would find. A lease that isn't refreshed expires at its end, whether or
not somebody asks. A failure waits as long as its message says, between bounds; after the last try the job has failed. Finished jobs are
forgotten after a while, so that state doesn't grow with all jobs ever seen.

Rows without a job or a time are no events. Events of the same time go by their number. Repeated events count again. An empty table gives
an empty result. One job's events are one walk with constant memory, so a very frequent job is one task: its leases depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an event asks for.
ASKS = ("submit", "acquire", "heartbeat", "done", "fail")
#: Seconds that a retry waits at least, at most and on top of what the message asks; and the tries.
RETRY_LEAST, RETRY_MOST, RETRY_MORE, TRIES = 5.0, 65.0, 1.5, 3
SECOND = 1_000_000
SCHEMA = "job string, us long, event long, outcome string, holder string, until_us long, tries long, next_us long"


def retry_seconds(message: Column) -> Column:
    """The wait that a failure's message asks for ("retry in 12.5s", the longest of several), within bounds."""
    asked = F.transform(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(r"(?i)retry in\s+(\d+(?:\.\d+)?)s"), F.lit(1)), lambda x: x.cast("double"))
    wait = F.coalesce(F.ceil(F.array_max(asked) * 1000) / 1000 + RETRY_MORE, F.lit(RETRY_LEAST))
    return F.greatest(F.lit(RETRY_LEAST), F.least(F.lit(RETRY_MOST), wait))


class Job(NamedTuple):
    """What is known of a job; ``status`` is queued, processing, retry, ready or failed."""

    status: str = "queued"
    holder: str | None = None
    until: int | None = None
    tries: int = 0
    next: int | None = None
    since: int = 0


FINAL = ("ready", "failed")


class Machine:
    """The transitions; times are microseconds."""

    def __init__(self, lease: float, retention: float, tries: int = TRIES):
        self.lease, self.retention, self.tries = int(lease * SECOND), int(retention * SECOND), tries

    def lapsed(self, job: Job | None, now: int) -> Job | None:
        """The job behind the end of its lease, if that has come."""
        if job is not None and job.holder is not None and job.until <= now:
            return job._replace(status="queued", holder=None, until=None, since=job.until)
        return None

    def forgotten(self, job: Job | None, now: int) -> bool:
        """Whether a finished job's time is over."""
        return job is not None and job.status in FINAL and now >= job.since + self.retention

    def step(self, job: Job | None, now: int, asks: str, worker: str, wait_us: int) -> tuple[Job, str]:
        """The job after an event, and what became of the event. The lease has been looked after before."""
        if job is None or self.forgotten(job, now):
            job = Job(since=now)
            if asks == "submit":
                return job, "queued"
        own = job.holder is not None and job.holder == worker
        if asks == "submit":
            return (Job(since=now), "queued") if job.status in FINAL else (job, "kept")
        if asks == "acquire":
            if job.status in FINAL:
                return job, "finished"
            if job.holder is not None and not own:
                return job, "busy"
            if job.next is not None and job.next > now:
                return job, "waiting"
            return job._replace(status="processing", holder=worker, until=now + self.lease, next=None, since=now), "refreshed" if own else "granted"
        if not own:
            return job, "lost"
        if asks == "heartbeat":
            return job._replace(until=now + self.lease, since=now), "refreshed"
        if asks == "done":
            return Job("ready", tries=job.tries, since=now), "ready"
        if job.tries + 1 > self.tries:
            return Job("failed", tries=job.tries + 1, since=now), "failed"
        return Job("retry", tries=job.tries + 1, next=now + wait_us, since=now), "retry"

    def walk(self, key: str, job: Job | None, events: Iterator[tuple[int, int, str, str, int]]) -> Iterator[tuple[Job | None, tuple | None]]:
        """The job and the row after each event (time, number, asks, worker, wait); expiries have rows of their own."""
        for now, event, asks, worker, wait_us in events:
            if (after := self.lapsed(job, now)) is not None:
                job = after
                yield job, row(key, job.since, None, "expired", job)
            job, outcome = self.step(job, now, asks, worker, wait_us)
            yield job, row(key, now, event, outcome, job)


def row(key: str, us: int, event: int | None, outcome: str, job: Job) -> tuple:
    return key, us, event, outcome, job.holder, job.until, job.tries, job.next


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of the result; whole numbers stay whole beside nulls."""
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")], dtype=object)
    return out.astype({c: "Int64" for c in ("us", "event", "until_us", "tries", "next_us")})


def events_of(table: DataFrame, job: Column, at: Column, event: Column, asks: Column, worker: Column, message: Column, scale: float = 1.0) -> DataFrame:
    """``job, us, event, asks, worker, wait_us`` from any table; ``scale`` stretches the waits."""
    wait = F.round(retry_seconds(message) * (scale * SECOND)).cast("long")
    rows = table.select(job.cast("string").alias("job"), F.unix_micros(at.cast("timestamp")).alias("us"), event.cast("long").alias("event"), asks.alias("asks"), worker.cast("string").alias("worker"), wait.alias("wait_us"))
    return rows.where(F.col("job").isNotNull() & F.col("us").isNotNull() & F.col("asks").isin(*ASKS))


def stages(events: DataFrame, machine: Machine, clock_us: int | None = None) -> DataFrame:
    """All rows of all jobs. ``clock_us`` is the time up to which leases of the last events have run out; none: no lease is looked at again.

    The events are partitioned by job, sorted by Spark and streamed through a worker, which holds one job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, job = None, None

        def ended() -> list[tuple]:
            after = machine.lapsed(job, clock_us) if clock_us is not None else None
            return [row(key, after.since, None, "expired", after)] if after is not None else []

        for batch in batches:
            out = []
            for name, us, event, asks, worker, wait_us in batch.itertuples(index=False, name=None):
                if name != key:
                    out += ended()
                    key, job = name, None
                for job, made in machine.walk(key, job, iter([(int(us), int(event), asks, worker, int(wait_us))])):
                    out.append(made)
            yield frame(out)
        yield frame(ended())

    filled = events.withColumn("event", F.coalesce("event", F.lit(-1))).withColumn("worker", F.coalesce("worker", F.lit("")))
    return filled.repartition("job").sortWithinPartitions("job", "us", "event").mapInPandas(run, SCHEMA)
