"""A corpus pipeline from five of the operators: toxic and bad documents go, one document of each near-duplicate group
stays, sources are mixed to target weights, and the texts become token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet into the shared folder
and reads again for the next stage. All stages but the last return the columns of ``documents``. Nulls, empty and very long
texts, repeated rows, empty tables and extra columns are treated as the operators' docstrings say; documents with empty
texts fail the quality rules.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, mixing, neardup, quality, toxicity
from quillon.llm.common import file_row, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; it learns from the labels of those that came in.

    Each row goes by its own text. Null and empty texts stay, repeated rows go or stay together, an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules reject go.

    Each row goes by its own text, whatever its id. Null and empty texts have too few words and go; an empty table stays empty.
    """
    return quality.keep_good(docs, row=file_row(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more.

    Groups are of rows, so null and repeated ids lose no text; texts without words are in no group and stay. The least id of a
    group stays, of equal ids the first by hash. An empty table stays empty.
    """
    return neardup.keep_one(docs, neardup.Settings(shingle=5, percent=80), row_of=file_row(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Null sources are one source; empty texts have size 0 and may be taken or not; rows that are equal in all columns are
    taken as often as they would be one by one. An empty table stays empty.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, checked by decoding them; null and empty texts have none, an empty table stays empty."""
    coded = bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", F.col("ids"), F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A learned grammar, EM and a sentencepiece model can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
