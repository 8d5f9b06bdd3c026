"""Sharding by extendible hashing, from DataFrame functions alone.

A row's hash is 48 bits of the MD5 of its key and of its content's MD5. The directory is indexed by prefixes of the hash;
only buckets above the byte limit are split on another bit, until every shard fits.

The directory grows in rounds of ``STEP`` bits. In a round, the rows of buckets that are still too large are summed by
prefixes of ``STEP`` more bits (map-side combined, at most 2**STEP sums for each such bucket); from these sums come the
sums of all shorter prefixes, and each cell settles at the shortest prefix that fits. Texts are read once and never
shuffled: rounds work on (key, hash, bytes).

Rows whose 48 bits are equal (repeated rows) can't be told apart by more bits. A full-depth bucket that is still too large
gets overflow shards: its rows, equal in size, are dealt out by ordinal, as many to a shard as fit. A single row above the
limit is a shard by itself, marked ``oversized``.

Null keys and texts hash as such and count 0 bytes. Empty tables give an empty result. Repeated rows are all placed. Extra
columns stay with ``write_shards`` and aren't part of the assignment, so their names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, free_name, stored

BITS, STEP = 48, 8


def row_hash(key: Column, text: Column) -> Column:
    """48 bits as a string of 0 and 1, so that a prefix is a substring."""
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null"))))
    return F.lpad(F.conv(F.substring(digest, 1, BITS // 4), 16, 2), BITS, "0")


def assign_shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``key, n_bytes, shard, depth, shard_bytes, shard_rows, oversized`` for each row; ``shard`` is the hash prefix, with ``+n`` for overflow shards. With ``row``, a column that names rows, its values come along as ``row``."""
    also = ["row"] if row else []
    rows = docs.select(F.col(key).alias("key"), row_hash(F.col(key), F.col(text)).alias("hash"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), *([F.col(row).alias("row")] if row else []))
    rows = stored(rows, "shard-rows")
    waiting, settled = rows, []
    for depth in range(0, BITS, STEP):
        cells = waiting.groupBy(F.substring("hash", 1, depth + STEP).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        # every prefix of a cell that is longer than the buckets split so far; the first round also tries the undivided table
        first = depth if not depth else depth + 1
        sums = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(depth + STEP)))).withColumn("shard", F.expr("substring(cell, 1, depth)"))
        buckets = sums.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS))
        best = sums.join(fits, ["depth", "shard"]).groupBy("cell").agg(F.min_by(F.struct("shard", "depth", "shard_bytes", "shard_rows"), "depth").alias("to"))
        best = cut(cells.select("cell").join(best, "cell", "left"))
        settled.append(best.where(F.col("to").isNotNull()))
        more = best.where(F.col("to").isNull()).select("cell")
        if more.isEmpty():
            break
        waiting = waiting.join(more, F.substring("hash", 1, depth + STEP) == F.col("cell"), "left_semi")
    else:
        depth = BITS - STEP
    # one join places every row: a cell of any round is matched by its length and prefix
    placed = None
    waiting = rows
    for n, part in enumerate(settled):
        cut_at = (n + 1) * STEP
        here = waiting.join(part.select(F.col("cell").alias(f"cell{n}"), F.col("to").alias(f"to{n}")), F.substring("hash", 1, cut_at) == F.col(f"cell{n}"), "left").drop(f"cell{n}")
        waiting = here
    to = F.coalesce(*[F.col(f"to{n}") for n in range(len(settled))])
    placed = waiting.select("key", *also, "hash", "n_bytes", to.alias("to")).select("key", *also, "hash", "n_bytes", "to.*")
    normal = placed.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    full = placed.where((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1))
    normal = normal.withColumn("oversized", F.col("n_bytes") > limit).drop("hash")
    if len(settled) * STEP < BITS:
        return normal
    return normal.unionByName(overflow(full, limit, also))


def overflow(full: DataFrame, limit: int, also: list[str]) -> DataFrame:
    """Deal the rows of full-depth buckets out by ordinal. The ordinal is taken in two levels, within and over input partitions, so that no task gets a whole bucket."""
    full = cut(full.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("hash", "part").orderBy("key")
    parts = full.groupBy("hash", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.partitionBy("hash").orderBy("part")) - F.col("n"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    numbered = full.withColumn("nth", F.row_number().over(inside)).join(parts.drop("n"), ["hash", "part"])
    numbered = numbered.withColumn("nth", F.col("nth") + F.col("before") - 1).withColumn("page", F.floor(F.col("nth") / fit))
    in_page = F.least(fit, F.col("shard_rows") - F.col("page") * fit)
    return numbered.select(
        "key", *also, "n_bytes", F.concat("shard", F.lit("+"), F.col("page").cast("string")).alias("shard"), "depth",
        (in_page * F.col("n_bytes")).alias("shard_bytes"), in_page.alias("shard_rows"), (F.col("n_bytes") > limit).alias("oversized"),
    )


def write_shards(docs: DataFrame, limit: int, path: str, key: str = "doc_id", text: str = "text", folder: str = "shard") -> DataFrame:
    """Write each row once as Parquet, one folder for each shard, and return the directory.

    Rows are told apart by a row id of their own, so null and repeated keys are placed like others. An input column called like
    ``folder`` would lose its values to the folder names, so it raises.
    """
    if folder.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {folder}; name another folder")
    row = free_name(docs, "row_")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "shard-docs")
    assigned = stored(assign_shards(rows, limit, key, text, row), "shard-places")
    placed = rows.join(assigned.select(F.col("row").alias(row), F.col("shard").alias(folder)), row).drop(row)
    placed.repartition(folder).write.partitionBy(folder).parquet(path)
    return directory(assigned)


def directory(assigned: DataFrame) -> DataFrame:
    """One row for each shard."""
    return assigned.groupBy("shard", "depth").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))


def shards_sql(limit: int) -> str:
    """DuckDB's form over documents without repeated rows: for each row, the shortest prefix whose rows fit."""
    digest = "md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), 'null'))"
    depths = " UNION ALL ".join(f"SELECT {d} AS depth" for d in range(BITS + 1))
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, lpad(bin(CAST('0x' || substr({digest}, 1, {BITS // 4}) AS BIGINT)), {BITS}, '0') AS hash FROM documents
), depths AS ({depths}), sums AS (
  SELECT depth, substr(hash, 1, depth) AS shard, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM rows, depths GROUP BY ALL
), fits AS (
  SELECT * FROM sums WHERE shard_bytes <= {limit} OR shard_rows = 1
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, shard, CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_rows AS BIGINT) AS shard_rows, n_bytes > {limit} AS oversized
FROM (SELECT r.doc_id, r.n_bytes, f.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY f.depth) AS nth FROM rows r JOIN fits f ON f.shard = substr(r.hash, 1, f.depth))
WHERE nth = 1
"""
