"""Merging queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import merging as M
from quillon.operators import policies as P
from quillon.operators import retrieval as R
from quillon.plans.fixtures import derived, derived_values, frame
from quillon.plans.policies import ORACLE as POLICIES
from quillon.plans.retrieval import ORACLE as KNOWN
from quillon.plans.retrieval import table


def relevant_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's sources, merged by URL after disqualification."""
    asked, held = frame(spark, "queries"), derived(spark, sf_dir, "candidates").withColumn("body", F.concat_ws(" ", "document_number", "title", "snippet"))
    # each text is read once, not for each pair, and none is shuffled
    told = held.select("cid", "url", "score", T.once(T.normalise_plain(F.col("body"))).alias("body")).select("cid", "url", "score", T.once(P.held_by(F.col("body"))).alias("held"))
    questions = asked.select("qid", T.once(T.normalise_plain(F.col("query"))).alias("q")).select("qid", T.once(P.asked_of(F.col("q"))).alias("asked"))
    pairs = R.source_relevance(asked, held).join(told, "cid").join(questions, "qid")
    return M.merge_relevant(pairs, ["qid", "url"], P.unfit(F.col("asked"), F.col("held")), F.round("relevance", 6), "cid").select("qid", "url", "cid", F.round("score", 6).alias("score"))


def first_by_issuer(spark: SparkSession, sf_dir: str) -> DataFrame:
    issuer = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return M.first_candidates(derived(spark, sf_dir, "candidates"), "cid", F.col("document_number"), issuer).select("unique_key", "cid")


def first_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_candidates(derived(spark, sf_dir, "candidates"), "cid", F.col("document_number")).select("unique_key", "cid")


def broad_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = derived(spark, sf_dir, "candidates", True)
    topical = every.where(M.recent_topical(every, "2026-04-01", 2026))
    return M.precedence_union(every.where("cid = 7"), every.where("cid IN (1, 3)"), topical, "cid").select("merge_key", "precedence", "cid")


def pages_to_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return M.missing_pages(turns, turns.where(F.length("text") >= 60), ["conv_id", "turn"])


def retried_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short turns are read again; the new reading wins."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    again = turns.where(F.length("text") < 60).withColumn("text", F.concat(F.lit("again: "), "text"))
    return M.merge_pages(turns, again, ["conv_id", "turn"], "text").select("conv_id", "turn", "retried", F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (relevant_sources, first_by_issuer, first_by_number, broad_discovery, pages_to_retry, retried_pages)}

_BODY = POLICIES["disqualified_sources"].replace(D.normalise_plain("concat_ws(' ', title, snippet)"), D.normalise_plain("concat_ws(' ', document_number, title, snippet)"))
_number = f"regexp_replace({D.normalise_query(chr(99) + 'oalesce(document_number, ' + D.quote('') + ')')}, '\\s+', '', 'g')"
_issuer = D.normalise_query("regexp_extract(url, '^https?://([^/]+)', 1)")

ORACLE = {
    "relevant_sources": f"""
WITH r AS ({KNOWN['source_relevance']}), o AS ({_BODY}), s AS (
  SELECT qid, url, cid, c.score + greatest(0, r.relevance) AS score FROM r JOIN o USING (qid, cid) JOIN {derived_values('candidates')} c USING (cid) WHERE NOT o.out)
SELECT qid, url, cid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, url ORDER BY score DESC, cid) AS nth FROM s) WHERE nth = 1""",
    "first_by_issuer": f"SELECT unique_key, min(cid) AS cid FROM (SELECT cid, {_number} || ':' || {_issuer} AS unique_key FROM {derived_values('candidates')}) GROUP BY ALL",
    "first_by_number": f"SELECT unique_key, min(cid) AS cid FROM (SELECT cid, {_number} AS unique_key FROM {derived_values('candidates')}) WHERE unique_key <> '' GROUP BY ALL",
    "broad_discovery": f"""
WITH c AS (SELECT *, {D.number_key("coalesce(document_number, '')")} AS merge_key FROM {derived_values('candidates', True)}), u AS (
  SELECT merge_key, 0 AS precedence, cid, 0.0 AS s, cid AS o FROM c WHERE cid = 7 UNION ALL SELECT merge_key, 1, cid, 0.0, -cid FROM c WHERE cid IN (1, 3)
  UNION ALL SELECT merge_key, 2, cid, score, cid FROM c WHERE trim(coalesce(document_number, '')) <> '' AND coalesce(url, '') <> '' AND CASE WHEN issued_date IS NULL THEN contains(document_number, '/2026/') ELSE issued_date >= '2026-04-01' END)
SELECT merge_key, precedence, cid FROM (SELECT *, row_number() OVER (PARTITION BY merge_key ORDER BY precedence, s DESC, o) AS nth FROM u) WHERE nth = 1""",
    "pages_to_retry": "SELECT conv_id, turn FROM conversations EXCEPT SELECT conv_id, turn FROM conversations WHERE length(text) >= 60",
    "retried_pages": """
SELECT conv_id, turn, retried, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY retried DESC, text DESC) AS nth FROM (
  SELECT conv_id, turn, text, false AS retried FROM conversations UNION ALL SELECT conv_id, turn, 'again: ' || text, true FROM conversations WHERE length(text) < 60)) WHERE nth = 1""",
}
