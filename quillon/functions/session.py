"""Settings that the library's plans need in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def sound_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of frames that are partitioned alike for partitioned itself, though adaptive execution may have coalesced each of them
    by itself; an aggregation or window behind it then sees rows of a key in several groups. Off for the session, before a plan is made."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
