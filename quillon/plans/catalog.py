"""All queries of the library outside the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import anchored, etl, guards, harvest, ingestion, layout, listings, merging, pages, policies, presentation, publishing, retrieval, search, segments, selection, sheets, state, storyboard

PARTS = (retrieval, search, anchored, ingestion, pages, presentation, sheets, harvest, storyboard, etl, guards, layout, policies, segments, selection, state, merging, publishing, listings)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most relevant documents for a set of queries."""
    return retrieval.search_documents(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
