"""Spreadsheet-like tables: header mapping, row and column statistics, append without duplicates, keys, sequences, conclusions, table text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T


def map_headers(target: DataFrame, source: DataFrame) -> DataFrame:
    """For each target header, the first source column of the same name, or -1. Both have ``idx, header``."""
    named = source.select(T.header_key(F.col("header")).alias("name"), "idx").where("name <> ''").groupBy("name").agg(F.min("idx").alias("source"))
    return target.select("idx", T.header_key(F.col("header")).alias("name")).join(named, "name", "left").select("idx", F.coalesce("source", F.lit(-1)).alias("source"))


def value_kind(value: Column) -> Column:
    """blank, date, number or text."""
    v = F.trim(value)
    return (
        F.when(value.isNull() | (v == ""), "blank").when(v.rlike(r"^(?:\d{1,2}[/-]){2}\d{2,4}$") | v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), "date")
        .when(F.regexp_replace(v, r"\s", "").rlike(r"^[+-]?(?:\d+[.,]?)+%?$"), "number").otherwise("text")
    )


def cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A wide table as ``key, col, value`` cells."""
    parts = F.array(*[F.struct(F.lit(n).alias("col"), F.col(c).cast("string").alias("value")) for n, c in enumerate(columns)])
    return rows.select(key, F.explode(parts).alias("c")).select(key, "c.col", "c.value")


def column_stats(grid: DataFrame) -> DataFrame:
    """Of each column: filled cells, numeric share, longest value, distinct values."""
    kind = value_kind(F.col("value"))
    return grid.groupBy("col").agg(
        F.count(F.when(kind != "blank", 1)).alias("filled"), F.round(F.avg(kind.isin("number", "date").cast("double")), 6).alias("numeric"),
        F.max(F.length(F.trim("value"))).alias("longest"), F.count_distinct("value").alias("values"),
    )


def row_stats(grid: DataFrame, key: str) -> DataFrame:
    """Of each row: filled, text-like and numeric cells, distinct normalised values."""
    kind, name = value_kind(F.col("value")), F.nullif(T.header_key(F.col("value")), F.lit(""))
    return grid.groupBy(key).agg(F.count(F.when(kind != "blank", 1)).alias("filled"), F.count(F.when(kind == "text", 1)).alias("texts"), F.count(F.when(kind.isin("number", "date"), 1)).alias("numbers"), F.count_distinct(name).alias("values"))


def append_new(target: DataFrame, source: DataFrame, key: list[str], order: str) -> DataFrame:
    """Source rows whose key the target lacks, the first of each key within the source; rows with a null key are always appended."""
    known = target.select(*key).distinct()
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    keyed = source.where(~null).join(known, key, "left_anti")
    first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("nth = 1").drop("nth")
    return first.unionByName(source.where(null))


def duplicate_key(parts: list[Column]) -> Column:
    """Joined normalised parts, null if fewer than two are filled."""
    names = [T.header_key(p) for p in parts]
    filled = F.size(F.filter(F.array(*names), lambda x: x != ""))
    return F.when(filled >= 2, F.concat_ws("|", *names))


def conclusion(days: Column, amount: Column) -> Column:
    """How two records agree: by a difference in days and one in amount, either possibly missing."""
    gone = lambda c: c.isNull() | (c == "")
    off = lambda c, tolerance: F.abs(F.coalesce(c.try_cast("double"), F.lit(0.0))) > tolerance
    d, a = off(days, 1e-6), off(amount, 0.5)
    return F.when(gone(days) & gone(amount), "MISSING").when(d & a, "BOTH").when(d, "DATE").when(a, "AMOUNT").otherwise("MATCH")


def next_in_sequence(rows: DataFrame, column: str) -> DataFrame:
    """One more than the largest number in a column of texts."""
    number = F.regexp_replace(F.trim(F.col(column).cast("string")), "[^0-9.-]", "").try_cast("double")
    return rows.agg((F.coalesce(F.max(F.floor(number)), F.lit(0)) + 1).cast("bigint").alias("next"))


def fingerprint(rows: DataFrame, group: str, value: str) -> DataFrame:
    """SHA-256 of the sorted distinct values of each group; values are hashed first, so that a group's state is small."""
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.sha2(F.col(value).cast("string"), 256))), ","), 256).alias("fingerprint"))


def pipe_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Tables in text: runs of lines with the same number of pipe-separated cells, as islands; separator lines are dropped."""
    lines = docs.select(key, F.posexplode(F.split(T.tidy(F.col(text)), "\n")).alias("at", "line")).where(~F.col("line").rlike(r"^[\s|:+-]+$"))
    rows = lines.withColumn("cells", F.size(F.filter(F.split("line", r"\|"), lambda c: F.trim(c) != ""))).where(F.col("line").contains("|") & (F.col("cells") >= 2))
    line = Window.partitionBy(key).orderBy("at")
    starts = (F.col("at") - F.lag("at").over(line) > 1) | (F.col("cells") != F.lag("cells").over(line))
    rows = rows.withColumn("start", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("table", F.sum("start").over(line))
    return rows.groupBy(key, "table").agg(F.min("at").alias("first_line"), F.count(F.lit(1)).alias("rows"), F.first("cells").alias("cells"))
