"""The ingestion machine over all events, and its DuckDB SQL: a recursion over each job's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import ingestion as M
from quillon.plans.retrieval import table

#: What the event types stand for; hours of a lease, days until a finished job is forgotten, and how far waits are stretched.
ASKS_OF = {"signup": "submit", "view": "acquire", "click": "heartbeat", "purchase": "done", "error": "fail"}
LEASE_HOURS, KEEP_DAYS, SCALE, WORKERS = 36, 5, 3600, 3


def job_events(events: DataFrame) -> DataFrame:
    """Events of users as events of jobs; their values are what failures' messages ask to wait."""
    asks = F.element_at(F.create_map(*[F.lit(x) for pair in ASKS_OF.items() for x in pair]), F.col("event_type"))
    worker = F.concat(F.lit("w"), (F.col("event_id") % WORKERS).cast("string"))
    message = F.concat(F.lit("quota exceeded, retry in "), F.round("value", 2).cast("decimal(20,2)").cast("string"), F.lit("s"))
    return M.events_of(events, F.col("user_id"), F.col("ts"), F.col("event_id"), asks, worker, message, SCALE)


def machine() -> M.Machine:
    return M.Machine(LEASE_HOURS * 3600, KEEP_DAYS * 86_400)


def ingestion_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every event and every lease."""
    events = table(spark, sf_dir, "events")
    clock = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return M.stages(job_events(events), machine(), clock)


QUERIES = {"ingestion_stages": ingestion_stages}

_LEASE, _KEEP = LEASE_HOURS * 3_600_000_000, KEEP_DAYS * 86_400_000_000
_FINAL = "('ready', 'failed')"
_WAIT = f"greatest({M.RETRY_LEAST}::DOUBLE, least({M.RETRY_MOST}::DOUBLE, coalesce(ceil(CAST(CAST(round(value, 2) AS DECIMAL(20,2)) AS DOUBLE) * 1000) / 1000 + {M.RETRY_MORE}::DOUBLE, {M.RETRY_LEAST}::DOUBLE)))"


def _next(x: str, fresh: str) -> str:
    """A job's state behind an event: x.asks, x.worker, x.us, x.wait against (status, holder, until_us, tries, next_us, since)."""
    return f"""
SELECT job, n, us, event, lapsed, outcome,
  CASE outcome WHEN 'queued' THEN 'queued' WHEN 'granted' THEN 'processing' WHEN 'refreshed' THEN 'processing' WHEN 'ready' THEN 'ready' WHEN 'failed' THEN 'failed' WHEN 'retry' THEN 'retry' ELSE status END AS status,
  CASE WHEN outcome IN ('granted', 'refreshed') THEN worker WHEN outcome IN ('queued', 'ready', 'failed', 'retry') THEN NULL ELSE holder END AS holder,
  CASE WHEN outcome IN ('granted', 'refreshed') THEN us + {_LEASE} WHEN outcome IN ('queued', 'ready', 'failed', 'retry') THEN NULL ELSE until_us END AS until_us,
  CASE WHEN outcome = 'queued' THEN 0 WHEN outcome IN ('failed', 'retry') THEN tries + 1 ELSE tries END AS tries,
  CASE WHEN outcome = 'retry' THEN us + wait WHEN outcome IN ('granted', 'queued', 'ready', 'failed') OR (outcome = 'refreshed' AND asks = 'acquire') THEN NULL ELSE next_us END AS next_us,
  CASE WHEN outcome IN ('queued', 'granted', 'refreshed', 'ready', 'failed', 'retry') THEN us ELSE since END AS since
FROM (SELECT *, CASE asks
    WHEN 'submit' THEN CASE WHEN {fresh} OR status IN {_FINAL} THEN 'queued' ELSE 'kept' END
    WHEN 'acquire' THEN CASE WHEN status IN {_FINAL} THEN 'finished' WHEN holder IS NOT NULL AND holder <> worker THEN 'busy' WHEN next_us > us THEN 'waiting' WHEN holder = worker THEN 'refreshed' ELSE 'granted' END
    ELSE CASE WHEN holder IS NULL OR holder <> worker THEN 'lost' WHEN asks = 'heartbeat' THEN 'refreshed' WHEN asks = 'done' THEN 'ready' WHEN tries + 1 > {M.TRIES} THEN 'failed' ELSE 'retry' END END AS outcome
  FROM ({x}))"""


_NEW = "'queued' AS status, NULL::VARCHAR AS holder, NULL::BIGINT AS until_us, 0::BIGINT AS tries, NULL::BIGINT AS next_us, us AS since, true AS fresh"
_BEFORE = f"""
SELECT job, n, us, event, asks, worker, wait, CASE WHEN over THEN holder0_until END AS lapsed,
  CASE WHEN gone THEN 'queued' ELSE status END AS status, CASE WHEN gone THEN NULL ELSE holder END AS holder, CASE WHEN gone THEN NULL ELSE until_us END AS until_us,
  CASE WHEN gone THEN 0 ELSE tries END AS tries, CASE WHEN gone THEN NULL ELSE next_us END AS next_us, CASE WHEN gone THEN us ELSE since END AS since, gone AS fresh
FROM (SELECT *, status IN {_FINAL} AND us >= since + {_KEEP} AS gone FROM (
  SELECT e.*, w.holder IS NOT NULL AND w.until_us <= e.us AS over, w.until_us AS holder0_until,
    CASE WHEN w.until_us <= e.us THEN 'queued' ELSE w.status END AS status, CASE WHEN w.until_us <= e.us THEN NULL ELSE w.holder END AS holder,
    CASE WHEN w.until_us <= e.us THEN NULL ELSE w.until_us END AS until_us, w.tries, w.next_us, CASE WHEN w.until_us <= e.us THEN w.until_us ELSE w.since END AS since
  FROM walk w JOIN e ON e.job = w.job AND e.n = w.n + 1))"""

ORACLE = {
    "ingestion_stages": f"""
WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS job, epoch_us(ts) AS us, event_id AS event, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in ASKS_OF.items())} END AS asks, 'w' || (event_id % {WORKERS}) AS worker,
    CAST(round({_WAIT} * {SCALE * M.SECOND}.0::DOUBLE) AS BIGINT) AS wait, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), walk AS (
  {_next(f"SELECT job, n, us, event, asks, worker, wait, NULL::BIGINT AS lapsed, {_NEW} FROM e WHERE n = 1", 'fresh')}
  UNION ALL
  {_next(_BEFORE, 'fresh')}
), clock AS (SELECT max(epoch_us(ts)) AS now FROM events),
lapses AS (SELECT w.job, w.lapsed AS us, w.n, p.tries, p.next_us FROM walk w JOIN walk p ON p.job = w.job AND p.n = w.n - 1 WHERE w.lapsed IS NOT NULL),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n DESC) AS r FROM walk) WHERE r = 1)
SELECT job, us, event, outcome, holder, until_us, tries, next_us FROM walk
UNION ALL SELECT job, us, NULL, 'expired', NULL, NULL, tries, next_us FROM lapses
UNION ALL SELECT job, until_us, NULL, 'expired', NULL, NULL, tries, next_us FROM last, clock WHERE holder IS NOT NULL AND until_us <= now""",
}
