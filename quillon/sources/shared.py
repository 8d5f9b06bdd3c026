"""Tables that a query writes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``; under a local one only where that is unset and all runs in one process, as in tests."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        context.setCheckpointDir(root)
    return f"{root}/quillon-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, *partitions: str, codec: str = "snappy") -> DataFrame:
    """``df`` as Parquet under ``path``, read again: later readers prune columns and files, and a lost executor costs no recomputation."""
    to = df.write.option("compression", codec)
    to.partitionBy(*partitions).parquet(path) if partitions else to.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
