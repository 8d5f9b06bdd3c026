"""Merging of candidate lists and page stores by precedence: one window for each merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T


def _first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") == 1).drop("nth")


def merge_relevant(sources: DataFrame, keys: list[str], out: Column, relevance: Column, order: str) -> DataFrame:
    """Sources that aren't ``out``, their score raised by a relevance above zero; of each key the highest score, the first by ``order`` on ties."""
    raised = sources.where(~out).withColumn("score", F.col("score") + F.greatest(F.lit(0.0), relevance))
    return _first(raised, keys, F.col("score").desc(), F.col(order))


def first_candidates(rows: DataFrame, order: str, number: Column, issuer: Column | None = None) -> DataFrame:
    """The first row of each number and issuer, as ``unique_key``; without an issuer, of each number that isn't empty."""
    plain = lambda c: T.normalise_query(F.coalesce(c, F.lit("")))
    key = F.regexp_replace(plain(number), r"\s+", "")
    keyed = rows.withColumn("unique_key", key if issuer is None else F.concat(key, F.lit(":"), plain(issuer)))
    return _first(keyed if issuer is not None else keyed.where(F.col("unique_key") != ""), ["unique_key"], F.col(order))


def recent_topical(sources: DataFrame, cutoff: str, year: int) -> Column:
    """Whether a topical source has a number and URL and is recent: issued since ``cutoff`` or, undated, numbered in ``year``."""
    number, issued = F.trim(F.coalesce("document_number", F.lit(""))), F.nullif(F.col("issued_date"), F.lit(""))
    recent = F.when(issued.isNull(), F.contains(number, F.lit(f"/{year}/"))).otherwise(issued >= cutoff)
    return (number != "") & (F.coalesce("url", F.lit("")) != "") & recent


def precedence_union(exact: DataFrame, latest: DataFrame, topical: DataFrame, order: str) -> DataFrame:
    """One row of each document number: the first exact match, else the last of the latest feed, else the topical source with the highest score, first on ties."""
    parts = [part.withColumn("precedence", F.lit(n)) for n, part in enumerate((exact, latest, topical))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("merge_key", T.number_key(F.coalesce("document_number", F.lit(""))))
    score = F.when(F.col("precedence") == 2, F.col("score"))
    return _first(rows, ["merge_key"], F.col("precedence"), score.desc(), F.when(F.col("precedence") == 1, -F.col(order)).otherwise(F.col(order)))


def missing_pages(requested: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Requested pages that aren't completed yet, each once."""
    return requested.select(*keys).distinct().join(completed.select(*keys), keys, "left_anti")


def merge_pages(original: DataFrame, retried: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pages of both stores; a retried page replaces the original one, a later row an earlier one."""
    rows = original.withColumn("retried", F.lit(False)).unionByName(retried.withColumn("retried", F.lit(True)))
    return _first(rows, keys, F.col("retried").desc(), F.col(order).desc())
