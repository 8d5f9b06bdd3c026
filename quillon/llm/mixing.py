"""Mixing sources to target weights by systematic sampling.

Each document expects ``target / size of its source`` copies. Within a source, the documents stand in a fixed order; the
expected copies are prefix-summed, one random offset of the source is added, and a document is emitted once for every
integer boundary that its interval crosses. The order goes by size class, then by a slice of the document's hash, then by
size, so that a walk through the order passes all sizes and the words taken come near the target.

The prefix sums are exact integers (ranks), taken in two levels: the rank within a (source, size class, slice) cell, plus
the rows of the cells before it. No task holds a whole source: a hot source is spread over size classes times slices, whose
number grows with the rows. Equal rows are one row with a count until the end, so that a row that is repeated very often isn't
gathered anywhere. ``plan`` shuffles (key, source, size) and a hash, never texts; ``mix`` joins the copies to the rows.

Null sources are one source of their own, last in order. Null and empty texts have size 0 and add nothing to targets or
words. Repeated rows count each by itself. Ties in the order fall to the key, then to the hash of the text. Null and repeated
keys are as good as others. An empty table gives an empty result. A table without any word has targets of 0 and takes
nothing. Extra columns are not carried through ``plan``, so their names can't clash; ``mix`` keeps exactly the columns of its
input, each row as often as it is taken. Of rows that are equal in every column, it repeats one for all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, free_name, stored

#: Least number of slices of a (source, size class) cell, and rows of the table for each slice more; a cell is ranked by a task.
SLICES, ROWS_A_SLICE = 16, 1_000_000
#: Steps of the random offset; a power of two keeps offset plus rank exact.
STEPS = 1 << 20


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Bit length and the next four bits: sixteen classes to a doubling, from integers alone."""
    bits = F.length(F.bin(size)).cast("int")
    below = F.greatest(bits - 5, F.lit(0))
    return (bits * 16 + F.call_function("shiftright", size, below).cast("int") % 16).cast("int")


def unit(seed: int, source: Column) -> Column:
    """The source's random offset in [0, 1), the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null")).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % STEPS).cast("double") / STEPS


def shares(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], cap: int) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: weighted shares with a cap, the excess reshared by weight.

    Resharing until none is above its cap ends at the level ``x`` where the sum of min(cap * size, x * weight) meets the
    total. Sorted by cap * size / weight, the capped sources are a prefix, so the level follows from prefix sums. These
    windows see one row for each source (sources are aggregated first), not the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    every = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    ranked = (
        per.withColumn("limit", F.col("source_size") * cap)
        .withColumn("ratio", F.col("limit").cast("double") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(all_rows) * share[0] - F.coalesce(F.sum("limit").over(before), F.lit(0)) * share[1])
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / (F.col("open") * share[1]))
        .withColumn("fits", F.first(F.when(F.col("level") < F.col("ratio"), F.col("level")), ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("fits").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("fits") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def _hash(key: Column, text: Column) -> Column:
    """MD5 of a row's key and of its text's MD5."""
    return F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null"))))


def _copied(rows: DataFrame, order: list[Column], weights: Sequence[int], share: tuple[int, int], cap: int, seed: int) -> DataFrame:
    """``rows`` (``source, size, hash, n`` and others, ``n`` equal rows each) with the sums of their sources, ``each`` (the expected copies), ``offset`` and ``end``, the rank of the last of the n."""
    slices = max(SLICES, -(-(rows.agg(F.sum("n")).first()[0] or 0) // ROWS_A_SLICE))
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn("slice", (F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % slices).cast("int"))
    same = ["source", "class", "slice"]
    cells = rows.groupBy(*same).agg(F.sum("n").alias("rows"))
    line = Window.partitionBy("source").orderBy("class", "slice")
    cells = cells.withColumn("first", F.sum("rows").over(line) - F.col("rows"))
    sizes = rows.select("source", (F.col("size") * F.col("n")).alias("size"))
    cells = cells.join(shares(sizes, weights, share, cap).withColumn("offset", unit(seed, F.col("source"))).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "rows")
    inside = Window.partitionBy(*same).orderBy("size", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("rank", F.sum("n").over(inside))
    cells = cells.select(F.col("source").alias("source_"), F.col("class").alias("class_"), F.col("slice").alias("slice_"), "first", "source_size", "target", "offset")
    on = F.col("source").eqNullSafe(F.col("source_")) & (F.col("class") == F.col("class_")) & (F.col("slice") == F.col("slice_"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return ranked.join(cells, on).withColumn("each", each).withColumn("end", F.col("first") + F.col("rank"))


def _crossed(begin: Column, end: Column) -> Column:
    """Integer boundaries between two ranks."""
    return (F.floor(end * F.col("each") + F.col("offset")) - F.floor(begin * F.col("each") + F.col("offset"))).cast("long")


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2, seed: int = 7) -> DataFrame:
    """For each row: ``key, source, size, source_size, target, copies, taken``. ``share`` is the fraction of all words that the sources share."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), _hash(F.col(key), F.col(text)).alias("hash"))
    rows = rows.groupBy("key", "source", "size", "hash").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "mix-sizes")  # texts are read and counted once
    copied = _copied(rows, [F.col("key").asc_nulls_last(), F.col("hash")], weights, share, cap, seed)
    copied = copied.withColumn("end", F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))))
    out = copied.withColumn("copies", _crossed(F.col("end") - 1, F.col("end")))
    return out.select("key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2, seed: int = 7) -> DataFrame:
    """The mixed rows themselves, each as often as it is taken, with the columns of ``docs``."""
    row = free_name(docs, "row_")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    whole = [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]
    sizes = rows.select(F.col(row).alias("row"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), _hash(F.col(key), F.col(text)).alias("hash"), *[h.alias(f"whole{n}") for n, h in enumerate(whole)])
    sizes = stored(sizes.groupBy("source", "size", "hash", "whole0", "whole1").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), "mix-sizes")
    copied = _copied(sizes, [F.col("hash"), F.col("whole0"), F.col("whole1")], weights, share, cap, seed)
    taken = copied.select(F.col("row").alias(row), _crossed(F.col("end") - F.col("n"), F.col("end")).alias("copies")).where(F.col("copies") > 0)
    nth = free_name(docs, "nth_")
    taken = taken.select(row, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(nth))
    return rows.join(taken, row).select(*columns)


#: DuckDB's form of ``plan`` over documents, from the same integers.
PLAN_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), 'null')) AS hash
  FROM documents
), classed AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 5, 0)) % 16 AS class,
         CAST('0x' || substr(hash, 1, 8) AS BIGINT) % (SELECT greatest(16, CAST(ceil(count(*) / 1000000.0) AS BIGINT)) FROM rows) AS slice
  FROM rows
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, doc_id NULLS LAST, hash) AS rank FROM classed
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, CAST(list_extract([3, 1, 2], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS BIGINT) AS weight FROM per
), ratios AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) / weight AS ratio FROM weighed
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () * 3 - coalesce(sum(source_size * 2) OVER before, 0) * 2 AS DOUBLE)
            / CAST((sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) * 2 AS DOUBLE) AS level
  FROM ratios WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fitted AS (
  SELECT *, first_value(CASE WHEN level < ratio THEN level END IGNORE NULLS)
            OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fits FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN fits IS NULL THEN CAST(source_size * 2 AS DOUBLE) ELSE least(CAST(source_size * 2 AS DOUBLE), fits * weight) END AS target,
         CAST(CAST('0x' || substr(md5('7:' || coalesce('s' || source, 'null')), 1, 8) AS BIGINT) % 1048576 AS DOUBLE) / 1048576 AS off
  FROM fitted
), shares AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.rank, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS per_row
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(rank * per_row + off) - floor((rank - 1) * per_row + off) AS BIGINT) * size AS taken
FROM shares
"""
