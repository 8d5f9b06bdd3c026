"""The ingestion machine: single cases, and streams against whole tables."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import ingestion as M
from quillon.plans import ingestion as P
from quillon.streaming import ingestion as S


def outcomes(events, lease=100, retention=1000, tries=3):
    """Outcomes of (second, asks, worker[, wait]) events, expiries included."""
    machine = M.Machine(lease, retention, tries)
    rows = ((int(e[0] * M.SECOND), n, e[1], e[2], int((e[3] if len(e) > 3 else 5) * M.SECOND)) for n, e in enumerate(events))
    return [made[3] for _, made in machine.walk("j", None, rows)]


def test_a_lease_is_granted_refreshed_and_released():
    assert outcomes([(0, "submit", ""), (1, "acquire", "a"), (2, "acquire", "b"), (50, "heartbeat", "a"), (140, "acquire", "b"), (149, "done", "a"), (150, "acquire", "b")]) == [
        "queued", "granted", "busy", "refreshed", "busy", "ready", "finished"]


def test_a_lease_expires_and_its_holder_has_lost_it():
    assert outcomes([(0, "acquire", "a"), (100, "acquire", "b"), (101, "heartbeat", "a"), (102, "done", "a"), (103, "done", "b")]) == ["granted", "expired", "granted", "lost", "lost", "ready"]
    assert outcomes([(0, "acquire", "a"), (99, "acquire", "b"), (100, "fail", "a")]) == ["granted", "busy", "expired", "lost"]


def test_retries_wait_and_end():
    events = [(0, "acquire", "a"), (1, "fail", "a", 10), (5, "acquire", "a"), (11, "acquire", "a"), (12, "fail", "a"), (20, "acquire", "b"), (21, "fail", "b"), (30, "acquire", "b"), (31, "fail", "b"), (40, "acquire", "b"), (41, "submit", "")]
    assert outcomes(events) == ["granted", "retry", "waiting", "granted", "retry", "granted", "retry", "granted", "failed", "finished", "queued"]


def test_finished_jobs_are_forgotten():
    assert outcomes([(0, "acquire", "a"), (1, "done", "a"), (1000, "acquire", "b"), (1001, "acquire", "b"), (1002, "submit", "")]) == ["granted", "ready", "finished", "granted", "kept"]


def test_delays_follow_the_message_between_bounds(spark):
    messages = [None, "", "please retry in 12.5s", "Retry in 3s, or retry in 20s", "retry in 400s", "retry in 0.0001s", "retry later"]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in messages], "m STRING").select(M.retry_seconds(F.col("m"))).collect()]
    assert got == pytest.approx([5.0, 5.0, 14.0, 21.5, 65.0, 5.0, 5.0])


def test_rows_without_job_or_time_are_no_events(spark):
    rows = [(None, "2024-01-01 00:00:00", 1, "acquire"), ("a", None, 2, "acquire"), ("a", "2024-01-01 00:00:00", 3, "other"), ("a", "2024-01-01 00:00:01", None, "acquire"), ("a", "2024-01-01 00:00:01", None, "acquire")]
    df = spark.createDataFrame(rows, "j STRING, t STRING, e LONG, k STRING")
    events = M.events_of(df, F.col("j"), F.to_timestamp("t"), F.col("e"), F.col("k"), F.lit("w"), F.lit(None).cast("string"))
    assert [r["outcome"] for r in M.stages(events, M.Machine(10, 10)).collect()] == ["granted", "refreshed"]
    assert M.stages(events.limit(0), M.Machine(10, 10), 0).count() == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts, n = 5, events.count()
    for k in range(parts):  # files in order of time, within them in any order
        part = events.where(F.col("event_id").between(k * n // parts, (k + 1) * n // parts - 1)).orderBy(F.xxhash64("event_id"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streamed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = S.stages(P.job_events(streamed), P.machine(), "1 hour")
    query = out.writeStream.format("memory").queryName("stages").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    clock = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] - 3600 * M.SECOND
    want = M.stages(P.job_events(events), P.machine(), clock)
    assert sorted(map(tuple, spark.table("stages").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {r["outcome"] for r in want.collect()} >= {"granted", "expired", "busy", "retry", "ready", "waiting", "lost"}
