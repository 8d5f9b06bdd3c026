"""Rows against a stated query set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The most queries that are broadcast.
BLOCK = 1_000


def with_queries(rows: DataFrame, queries: DataFrame, n: int, block: int = BLOCK, slices: int = 64) -> DataFrame:
    """Every row with every query of a stated set of ``n``.

    A set of at most ``block`` queries is broadcast. A larger one is dealt in blocks of about that size and each block meets
    ``slices`` shares of the rows by an ordinary join, so no set beyond the bound is broadcast and no task holds a whole side.
    """
    if n <= block:
        return rows.crossJoin(F.broadcast(queries))
    blocks = -(-n // block)
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    share = lambda df, of: F.pmod(F.xxhash64(*df.columns), F.lit(of)).cast("int")
    left = rows.withColumn("_slice", share(rows, slices)).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", share(queries, blocks)).withColumn("_slice", every(slices))
    return left.join(right, ["_block", "_slice"]).drop("_block", "_slice")
