"""What the corpus operators share: reading tables, cutting lineage, bounded Python batches, 64-bit mixing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of code points that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that separates words.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sound_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of frames that are partitioned alike for partitioned itself, though adaptive execution may have coalesced each of them by itself; rows of a key then come in several groups. Off for the session, before a plan is made."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all is in one process, as in tests."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared one; ``discard`` deletes it."""
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


_written: list[str] = []


def discard(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written, once no frame that reads them is needed any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    count = len(_written)
    while _written:
        path = hadoop(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a table: Parquet in the shared folder, so later reads prune columns and survive lost executors."""
    sound_unions(df.sparkSession)
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Keep Arrow batches of long texts small, so that a Python worker's memory is bounded by ``rows`` texts and, but for a single longer text, by ``size`` bytes. Set for the session, where smaller values stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def file_row(df: DataFrame) -> Column | None:
    """What names each row of a table as it was read from files: the file's hash and the place in it. None for other tables; not for tables that repeat rows of files, by a join or a generator."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return None
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, so that helper columns never clash with the caller's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table. A written table rather than ``checkpoint()``: a checkpointed frame keeps its plan's constraints, which grow exponentially in loops.

    At most one file for each core, so that the many rounds of a loop don't leave a file for each shuffle partition. The rows are dealt
    out for that: merging partitions in place would hold the sorters of all of them in one task.
    """
    return stored(df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism)), "cut")
