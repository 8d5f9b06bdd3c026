"""Structured Streaming forms of the incremental operators: claims, quotas, rate limits, first-seen index, exactly-once dispatch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from quillon.streaming.ingestion import keyed_state


def claims(stream: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Put-if-absent by key and hour, for rows up to ``late`` behind the latest one.

    State of a claim expires a watermark's delay after its time, so the delay has to span the whole hour beside ``late``.
    """
    hours = stream.withWatermark(at, f"{late} 1 hour").withColumn("hour", F.date_trunc("hour", at))
    return hours.dropDuplicatesWithinWatermark([key, "hour"])


def daily_counts(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Tumbling days with a watermark for late events."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), key, "n")


class _Windows(StatefulProcessor):
    """Fixed windows anchored at a key's first event: start and events of the open window, and a timer at its end that forgets it."""

    def __init__(self, window_us: int, most: int):
        self.window_us, self.most = window_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("window", "start long, count long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        start, count = self.state.get() if self.state.exists() else (None, 0)
        before, out = start, []
        # the events of a micro-batch come in any order, also across Arrow batches
        for us in sorted(int(us) for batch in rows for us in batch.us):
            if start is None or us - start >= self.window_us:
                start, count = us, 0
            count += 1
            out.append((key[0], us, count, count <= self.most))
        self.state.update((start, count))
        if start != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(start + self.window_us) // 1000))
        yield pd.DataFrame(out, columns=["key", "us", "place", "allowed"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["key", "us", "place", "allowed"])

    def close(self) -> None:
        pass


def rate_limits(stream: DataFrame, key: str, at: str, window: int = 60, most: int = 24, late: str = "10 minutes") -> DataFrame:
    """Fixed windows anchored at a key's first event. A key's state goes when the watermark passes its window, so it doesn't grow with all keys ever seen."""
    keyed_state(stream.sparkSession)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Windows(window * 1_000_000, most), "key string, us long, place long, allowed boolean", "append", "eventtime")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class FirstSeen:
    """A first-seen index kept by ``foreachBatch``: versioned Parquet, one version for each batch, so a repeated batch overwrites its own version.

    Keys not seen for ``keep_days`` before the latest time are forgotten, and only the two latest versions stay: the one that a repeated
    batch starts from, and its own.
    """

    SCHEMA = "key string, first_seen timestamp, last_seen timestamp"

    def __init__(self, path: str, key: str, at: str, keep_days: int | None = None):
        self.path, self.key, self.at, self.keep_days = path, key, at, keep_days

    def index(self, spark: SparkSession, before: int) -> DataFrame:
        return _read(spark, f"{self.path}/version={before}", self.SCHEMA) if before >= 0 else spark.createDataFrame([], self.SCHEMA)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = batch.groupBy(F.col(self.key).cast("string").alias("key")).agg(F.min(self.at).cast("timestamp").alias("first_seen"), F.max(self.at).cast("timestamp").alias("last_seen"))
        merged = self.index(spark, number - 1).unionByName(seen).groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        if self.keep_days is not None:
            latest = merged.agg(F.max("last_seen").alias("latest"))  # one row
            merged = merged.join(F.broadcast(latest), F.col("last_seen") >= F.col("latest") - F.expr(f"INTERVAL {self.keep_days} DAYS")).drop("latest")
        merged.write.mode("overwrite").parquet(f"{self.path}/version={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


class Dispatch:
    """Exactly-once output: rows without a receipt are written under the batch's number together with their receipts."""

    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def __call__(self, batch: DataFrame, number: int) -> None:
        keys = batch.select(self.key).distinct()
        schema = keys.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", batch int"
        sent = _read(batch.sparkSession, self.path, schema).where(F.col("batch") != number)
        keys.join(sent.select(self.key), self.key, "left_anti").write.mode("overwrite").parquet(f"{self.path}/batch={number}")
