"""Incremental state as keyed tables: first-seen index, quotas, cooldowns, claims, rate limits, publishing, retention, dispatch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_first_seen(index: DataFrame, batch: DataFrame, now: str, retention_days: int = 180) -> tuple[DataFrame, DataFrame]:
    """The merged index (``key, first_seen, last_seen``) and the keys that are new in it.

    The first seen time of a key stays, the last seen time moves, entries unseen for the retention time go. An empty index
    makes nothing new: the first poll only fills it.
    """
    at = F.lit(now).cast("timestamp")
    kept = index.where(F.col("last_seen") >= at - F.expr(f"INTERVAL {retention_days} DAYS"))
    seen = batch.where(F.col("key").isNotNull() & (F.col("key") != "")).select("key").distinct()
    merged = kept.join(seen.withColumn("here", F.lit(True)), "key", "full").select(
        "key", F.coalesce("first_seen", at).alias("first_seen"), F.when(F.col("here"), at).otherwise(F.col("last_seen")).alias("last_seen"),
    )
    bootstrapped = index.limit(1).agg((F.count(F.lit(1)) > 0).alias("filled"))  # one row, so the join below is a lookup
    new = seen.join(kept, "key", "left_anti").crossJoin(F.broadcast(bootstrapped)).where("filled").select("key")
    return merged, new


def daily_claims(requests: DataFrame, quota: int) -> DataFrame:
    """The first ``quota`` distinct keys of each day, by first request; ``requests`` has ``day, key, ord``."""
    first = requests.groupBy("day", "key").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy("ord", "key"))
    return first.withColumn("rank", rank).where(F.col("rank") <= quota)


def ingestion_decision(states: DataFrame, now: str, retry_hours: int = 12) -> DataFrame:
    """Whether to start: forced, new, ready, processing, waiting for a retry or due; an unreadable time is due."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("updated_at"))) / 3600.0
    reason = (
        F.when(F.col("forced"), "forced").when(F.col("status").isNull(), "new").when(F.col("status") == "ready", "ready").when(F.col("status") == "processing", "processing")
        .when(age.isNull() | (age >= retry_hours), "retry_due").otherwise("retry_wait")
    )
    return states.withColumn("reason", reason).withColumn("start", F.col("reason").isin("forced", "new", "retry_due"))


def hourly_claims(requests: DataFrame, key: str, at: str) -> DataFrame:
    """Put-if-absent by key and hour: the first request of each."""
    return requests.groupBy(key, F.date_trunc("hour", at).alias("hour")).agg(F.min(at).alias("claimed"), F.count(F.lit(1)).alias("asked"))


def rate_limited(requests: DataFrame, key: str, at: str, event: str, window: int = 60, most: int = 24) -> DataFrame:
    """Fixed windows anchored at each key's first event: position in the window and whether it is allowed.

    Where a window starts depends on all events before, so a key's events are walked in order; they are sorted by Spark and
    streamed, with one window's state in memory, so a hot key isn't gathered.
    """
    rows = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(event).cast("bigint").alias("event"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, count = None, 0, 0
        for batch in batches:
            places, starts = [], []
            for k, us in zip(batch.key.tolist(), batch.us.tolist(), strict=True):
                if k != now or us - start >= window * 1_000_000:
                    now, start, count = k, us, 0
                count += 1
                places.append(count)
                starts.append(start)
            yield pd.DataFrame({"key": batch.key, "event": batch.event, "window_us": starts, "place": places})

    walked = rows.repartition("key").sortWithinPartitions("key", "us", "event").mapInPandas(walk, "key bigint, event bigint, window_us bigint, place bigint")
    return walked.withColumn("allowed", F.col("place") <= most).withColumn("remaining", F.greatest(F.lit(0), F.lit(most) - F.col("place")))


def revisions(published: DataFrame, key: str, at: list[str]) -> DataFrame:
    """Current and previous revision of each key from an append-only table."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in at]))
    return published.withColumn("nth", rank).where(F.col("nth") <= 2).withColumn("role", F.when(F.col("nth") == 1, "current").otherwise("previous")).drop("nth")


def pending_deliveries(notices: DataFrame, subscribers: DataFrame, receipts: DataFrame) -> DataFrame:
    """Deliveries that are due: subscribed before the notice, in its topic, without a receipt. Equi-join on the topic, anti-join on receipts."""
    due = notices.join(subscribers, "topic").where(F.col("subscribed") <= F.col("published"))
    return due.join(receipts, ["notice", "subscriber"], "left_anti").select("notice", "subscriber")


def due_counts(notices: DataFrame, subscribers: DataFrame) -> DataFrame:
    """``notice, due``: how many of a topic's ``subscribers`` had subscribed before each notice, notices without one left out.

    For receipts that hold for all notices of a topic; such subscribers are left out of ``subscribers``. Then the deliveries of a notice are those up
    to its place in the topic's order by time, and a running count takes the place of their pairs, which grow with the square of a topic.
    """
    known = lambda df, at: df.where(F.col("topic").isNotNull() & F.col(at).isNotNull())
    began = known(subscribers, "subscribed").groupBy("topic", F.col("subscribed").alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("notice", F.array().cast("array<bigint>"))
    told = known(notices, "published").where("notice IS NOT NULL").groupBy("topic", F.col("published").alias("at")).agg(F.lit(0).cast("bigint").alias("n"), F.collect_list(F.col("notice").cast("bigint")).alias("notice"))
    until = Window.partitionBy("topic").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = began.unionByName(told).withColumn("due", F.sum("n").over(until)).where("due > 0")
    return rows.select(F.explode("notice").alias("notice"), "due").groupBy("notice").agg(F.sum("due").alias("due"))


def union_minus(first: DataFrame, second: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Union of two stores, first store first, without tombstoned keys."""
    every = first.withColumn("store", F.lit(0)).unionByName(second.withColumn("store", F.lit(1)))
    one = every.groupBy(key).agg(F.min("store").alias("store"))
    return one.join(gone.select(key), key, "left_anti")


def upload_sessions(chunks: DataFrame) -> DataFrame:
    """Completeness of chunked uploads: all indexes, the exact size, and the missing indexes."""
    rows = chunks.groupBy("file").agg(F.max("total").alias("total"), F.max("size").alias("size"), F.sum("bytes").alias("received"), F.collect_set("idx").alias("have"))
    missing = F.array_except(F.sequence(F.lit(0), F.col("total") - 1), "have")
    return rows.select("file", "received", F.array_join(F.array_sort(missing).cast("array<string>"), ",").alias("missing"), ((F.size(missing) == 0) & (F.col("received") == F.col("size"))).alias("complete"))


def last_writes(rows: DataFrame, keys: list[str], at: list[str], values: list[str]) -> DataFrame:
    """Keyed upsert: the last write of each key wins."""
    last = F.max_by(F.struct(*values), F.struct(*at)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def sticky_status(rows: DataFrame, key: str, status: str, at: list[str], final: str) -> DataFrame:
    """The last status of each key, unless a final one was ever reached."""
    return rows.groupBy(key).agg(F.when(F.max(F.col(status) == final), F.lit(final)).otherwise(F.max_by(status, F.struct(*at))).alias("status"))


def within(at: Column, now: str, days: int, ahead_days: int = 1) -> Column:
    """Retention: not older than ``days`` and not further in the future than ``ahead_days``."""
    clock = F.lit(now).cast("timestamp_ntz")
    return (at >= clock - F.expr(f"INTERVAL {days} DAYS")) & (at <= clock + F.expr(f"INTERVAL {ahead_days} DAYS"))
