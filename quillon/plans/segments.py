"""Segmentation queries. Greedy packing restarts its running length, which the SQL check can't express; tests hold them against loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import segments as G
from quillon.plans.retrieval import table


def _chunks(docs: DataFrame, key: str, chunks: Column) -> DataFrame:
    return docs.select(key, F.posexplode(chunks).alias("nth", "chunk")).select(key, "nth", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def speech_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(table(spark, sf_dir, "documents"), "doc_id", G.speech_chunks(F.col("text")))


def caption_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(table(spark, sf_dir, "documents"), "doc_id", G.captions(F.col("text")))


def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(table(spark, sf_dir, "documents"), "doc_id", G.evidence_chunks(F.col("text")))


QUERIES = {f.__name__: f for f in (speech_chunks, caption_chunks, evidence_chunks)}
ORACLE: dict[str, str] = {}
