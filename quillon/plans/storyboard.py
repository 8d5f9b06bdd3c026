"""Coverage and storyboards of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.operators import storyboard as S
from quillon.plans.retrieval import table
from quillon.sources.shared import shared_folder

#: Categories in the words of the documents.
CATEGORIES = [("numbers", r"\d"), ("table", r"\|"), ("licence", r"[Ll]icen[cs]e"), ("english", r"(?:^|\s)the\s"), ("french", r"(?:^|\s)(?:les|une)\s"), ("german", r"(?:^|\s)(?:und|der)\s")]


def titled(docs: DataFrame) -> DataFrame:
    return docs.withColumn("title", F.concat_ws(" ", F.lit("Document"), F.col("doc_id").cast("string"), "source"))


def repaired_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each category that a document shows, how many of its points have it, and the first of them; categories without one got the first sentence that matches."""
    docs = table(spark, sf_dir, "documents")
    points = S.repaired(docs, S.sentence_points(docs, "doc_id", "text", CATEGORIES), "doc_id", "text", CATEGORIES)
    rows = points.select(F.col("key").alias("doc_id"), F.explode("covers").alias("category"), "nth", "claim", "importance")
    return rows.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.max("importance").alias("importance"), F.md5(F.min_by("claim", "nth")).alias("claim_md5"))


def storyboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes of all documents; held against loops in the tests."""
    board = S.storyboards(titled(table(spark, sf_dir, "documents")), "doc_id", "text", "title", CATEGORIES, "standard", False, shared_folder(spark, "storyboards"))
    return board.select("doc_id", "scene", "kind", "category", F.size("points").alias("n_points"), F.md5("title").alias("title_md5"), F.md5("narration").alias("narration_md5"))


QUERIES = {f.__name__: f for f in (repaired_points, storyboards)}

_Q = D.quote
_SENTENCES = f"list_transform(string_split(regexp_replace({D.squeeze(chr(99) + 'oalesce(text, ' + _Q('') + ')')}, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x))"

ORACLE = {
    "repaired_points": f"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS body, {_SENTENCES} AS l FROM documents), c AS (SELECT * FROM (VALUES {', '.join(f"({_Q(n)}, {_Q(p)})" for n, p in CATEGORIES)}) c(category, pattern)),
g AS (SELECT doc_id, list_filter(l, lambda x: length(x) BETWEEN 35 AND 420) AS good FROM s),
p AS (SELECT doc_id, unnest(good) AS claim, generate_subscripts(good, 1) - 1 AS nth FROM g),
h AS (SELECT doc_id, category, count(*) AS n, max(CASE WHEN nth < 2 THEN 4 ELSE 3 END) AS importance, arg_min(claim, nth) AS claim FROM p JOIN c ON regexp_matches(claim, pattern) GROUP BY ALL),
f AS (SELECT doc_id, category, list_filter(l, lambda x: length(x) >= 12 AND regexp_matches(x, pattern))[1] AS claim FROM s JOIN c ON regexp_matches(body, pattern))
SELECT doc_id, category, n, importance, md5(claim) AS claim_md5 FROM h
UNION ALL SELECT doc_id, category, 1, 2, md5(claim) FROM f WHERE claim IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = f.doc_id AND h.category = f.category)""",
}
