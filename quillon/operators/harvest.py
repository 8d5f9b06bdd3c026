"""Strings and links out of JSON of any shape, level by level.

A document is parsed once into a variant. Each level replaces the containers among its rows by what they hold, leaves pass on; so a walk of six
levels is one chain of generators, without a schema and without a Python function.

Null and broken documents hold nothing. Values deeper than ``depth`` are left out, as is all that isn't a string; of equal strings each place counts. Repeated
keys stay apart as far as their keys do. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: kinds of attachments, best first.
KINDS = [r"(?i)\.docx(?:$|[?#])", r"(?i)\.doc(?:$|[?#])", r"(?i)\.pdf(?:$|[?#])"]
LINK = r"(https?://[^\s\"'<>]+)"


def strings(rows: DataFrame, key: str, json: str, depth: int = 6, most: int = 500) -> DataFrame:
    """``key, path, text``: the strings of each document, ``path`` their places from the root on; at most the first ``most`` of a document."""
    spark = rows.sparkSession
    now = rows.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("path"), F.try_parse_json(F.col(json)).alias("v"))
    holds = "schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'"
    for _ in range(depth):
        marked = now.withColumn("inner", F.expr(f"CASE WHEN {holds} THEN v END"))
        now = spark.sql(
            "SELECT t.key, CASE WHEN t.inner IS NULL THEN t.path ELSE array_append(t.path, e.pos) END AS path, CASE WHEN t.inner IS NULL THEN t.v ELSE e.value END AS v FROM {marked} t, LATERAL variant_explode_outer(t.inner) e",
            marked=marked)
    found = now.where("schema_of_variant(v) = 'STRING'").select("key", "path", F.variant_get("v", "$", "string").alias("text"))
    # a document's strings are counted inside it, so the first ones are known without a window over documents
    per = found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("path", "text"))), 1, most).alias("all"))
    return per.select(F.col("key").alias(key), F.inline("all"))


def links(text: Column) -> Column:
    """Links of a text, without the marks that end a sentence."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,;:!?)\]]+$", ""))


def priority(link: Column) -> Column:
    """0 for the best kind of attachment, then on; other links last."""
    kind = F.lit(len(KINDS))
    for n, pattern in reversed(list(enumerate(KINDS))):
        kind = F.when(link.rlike(pattern), n).otherwise(kind)
    return kind


def best_links(rows: DataFrame, key: str, json: str, **bounds: int) -> DataFrame:
    """``key, n_strings, n_links, best``: of the documents with a string, how many strings and distinct links they hold, and the best link."""
    found = strings(rows, key, json, **bounds).withColumn("links", links(F.col("text")))
    each = found.select(key, F.explode_outer("links").alias("link"), "path").withColumn("rank", F.when(F.col("link").isNotNull(), F.struct(priority(F.col("link")).alias("kind"), "link")))
    return each.groupBy(key).agg(F.count_distinct("path").alias("n_strings"), F.count_distinct("link").alias("n_links"), F.min("rank")["link"].alias("best"))
