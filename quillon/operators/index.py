"""An inverted index over a collection: relevance without pairs that share no token.

``build`` writes two tables. ``documents`` holds each normalised text once. ``postings`` holds (token, document, flags), in files by a hash
of the token; the postings of a token that more than ``heavy`` documents have are spread over several files, by document. A query set is
exploded into tokens and joined to the postings of its buckets alone; shared tokens are counted by (query, document).

The phrase bonus needs the text itself. Its size is known, so the k-th best score without it bounds which documents it can bring among the
k best; only these pairs meet texts. The result is that of ``retrieval.lexical_relevance`` and a top-k over all pairs.

Null and empty texts have no postings and are found by nothing. Queries without tokens find nothing. Rows with a null or repeated key are
told apart no more than their keys are: keys should be unique. Ties go to the smaller key. An empty collection gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import retrieval as R
from quillon.sources.shared import written

#: Files' hash buckets, and documents of a token from which its postings are spread.
BUCKETS, HEAVY = 64, 1_000_000
#: What a phrase adds to a score, and what sums of the same terms in another order differ by at most.
PHRASE, ROUNDING = 0.25, 1e-9


class Index(NamedTuple):
    """The two tables of an index."""

    documents: DataFrame
    postings: DataFrame


def build(docs: DataFrame, path: str, key: str = "cid", body: str = "body", stop: list[str] = T.STOP_WORDS, heavy: int = HEAVY) -> Index:
    """Index ``docs`` under ``path``: texts are normalised once, postings written by bucket."""
    held = docs.select(F.col(key).alias("cid"), T.once(T.normalise_query(F.coalesce(F.col(body), F.lit("")))).alias("c"))
    held = held.select("cid", "c", R.flags_of(F.col("c")).alias("flags"), T.distinct_tokens(T.tokens_of(F.col("c"), stop)).alias("tokens"))
    documents = written(held, f"{path}/documents")
    each = documents.select("cid", "flags", F.explode("tokens").alias("token"))
    # at most rows / heavy tokens: small against the postings, and left to Spark's own size check
    spread = each.groupBy("token").count().where(F.col("count") > heavy).select("token", F.ceil(F.col("count") / heavy).alias("parts"))
    # without a frequent token there is nothing to join
    each = each.withColumn("parts", F.lit(None).cast("long")) if spread.isEmpty() else each.join(spread, "token", "left")
    each = each.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int"))
    each = each.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("cid"), F.col("parts"))).otherwise(0).cast("int"))
    dealt = each.repartition("bucket", "part").sortWithinPartitions("bucket", "token", "cid").select("token", "cid", "flags", "part", "bucket")
    return Index(documents, written(dealt, f"{path}/postings", "bucket"))


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    return Index(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings"))


def asked_of(queries: DataFrame, query: str = "query", stop: list[str] = T.STOP_WORDS) -> DataFrame:
    """``qid, q, q_tokens`` of a stated query set."""
    return queries.select("qid", T.once(T.normalise_query(F.col(query))).alias("q")).select("qid", "q", T.once(T.distinct_tokens(T.tokens_of(F.col("q"), stop))).alias("q_tokens"))


def matches(index: Index, asked: DataFrame) -> DataFrame:
    """``qid, cid, matched, flags`` for all pairs that share a token."""
    wanted = asked.select("qid", F.explode("q_tokens").alias("token"))
    # at most BUCKETS numbers: which files are read
    buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
    found = index.postings.where(F.col("bucket").isin(buckets)).join(wanted, "token")
    return found.groupBy("qid", "cid").agg(F.count(F.lit(1)).cast("int").alias("matched"), F.max("flags").alias("flags"))


def search(index: Index, queries: DataFrame, k: int, query: str = "query", stop: list[str] = T.STOP_WORDS) -> DataFrame:
    """``qid, cid, relevance, rank``: the k most relevant documents of each query, ties by key."""
    asked = asked_of(queries, query, stop).withColumn("n", F.size("q_tokens"))
    rows = matches(index, asked).join(asked.drop("q_tokens"), "qid")
    q, n, matched, flags = (F.col(c) for c in ("q", "n", "matched", "flags"))
    score = lambda phrase: R.relevance_score(q, n, matched, phrase, flags)
    rows = rows.withColumn("relevance", score(F.lit(False)))
    order = Window.partitionBy("qid").orderBy(F.desc("relevance"), "cid")
    best = rows.select("qid", "cid", "relevance", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    least = best.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("relevance")).alias("least"))
    # a phrase holds all its tokens but for the first and the last, which may be parts of longer words; its bonus can't exceed PHRASE
    maybe = rows.join(least, "qid").where((F.length(q) > 3) & (matched >= n - 2) & (F.col("least").isNull() | (F.col("relevance") + PHRASE + ROUNDING >= F.col("least"))))
    maybe = maybe.join(index.documents.select("cid", "c"), "cid").where(F.contains("c", q)).select("qid", "cid", score(F.lit(True)).alias("relevance"))
    every = best.select("qid", "cid", "relevance").unionByName(maybe).groupBy("qid", "cid").agg(F.max("relevance").alias("relevance"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
