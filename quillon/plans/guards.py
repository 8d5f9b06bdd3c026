"""Guard queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.operators import guards as G
from quillon.operators import retrieval as R
from quillon.plans.fixtures import derived, derived_values
from quillon.plans.retrieval import _PLANS, table

_Q = D.quote
FILES = [
    ("a.pdf", "application/pdf", "ready", None, 3, 3, None, None, "2026-07-20 10:00:00"), ("b.PDF", "", "processing", None, 0, 5, None, None, "2026-07-20 11:58:00"), ("c.pdf", "", "processing", None, 0, 5, None, None, "2026-07-20 11:00:00"),
    ("d.pdf", "", "ocr_partial", None, 1, 5, None, "2026-07-20 13:00:00", "2026-07-20 11:00:00"), ("e.pdf", "", "ocr_partial", None, 1, 5, None, None, "2026-07-20 11:00:00"), ("f.pdf", "", "failed", None, 1, 5, "HTTP 429 quota", None, None),
    ("g.pdf", "", "failed", "pdf_ocr", 5, 5, "corrupt", None, None), ("h.docx", "", "ocr_partial", None, 0, 1, None, None, None), ("i.pdf", "", "failed", "pdf_ocr", 2, 5, "corrupt", None, None), ("j.pdf", "", "processing", None, 0, 5, None, None, "bad"),
]
_FILES = "name STRING, content_type STRING, status STRING, method STRING, done INT, pages INT, error STRING, next_try STRING, updated_at STRING"


def enriched_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = derived(spark, sf_dir, "queries")
    plans = R.question_plans(asked).join(asked, "qid")
    return plans.select("qid", G.enriched(plans, "query", "21/07/2026").alias("question"))


def guarded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the status fixture with every combination of flags."""
    flags = spark.sql("SELECT s AS shell, c AS conflict, v AS verified, r AS relevance FROM VALUES (true), (false) s(s), VALUES (true), (false) c(c), VALUES (true), (false) v(v), VALUES (1.0D), (2.0D) r(r)")
    rows = derived(spark, sf_dir, "statuses").crossJoin(F.broadcast(flags)).withColumn("confidence", F.lit(0.9))
    return G.guarded(rows)


def recent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "candidates")
    return rows.select("cid", G.recent(rows, "issued_date", "document_number", "2026-07-21").alias("recent"))


def scheduled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.needs_run(spark.createDataFrame(FILES, _FILES), "2026-07-20 12:00:00").select("name", "run")


def matching_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market segment, as a sheet whose headers are its customers' nations, that shares most with the suppliers' nations."""
    nation = table(spark, sf_dir, "nation")
    sheets = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("sheet"), F.col("n_name").alias("header"))
    target = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("header"))
    return G.best_match(sheets, target)


QUERIES = {f.__name__: f for f in (enriched_questions, guarded_responses, recent_candidates, scheduled_files, matching_sheet)}

_HEAD, _TAIL = G.SUFFIX.split("{}")
_part = lambda label, c: f"CASE WHEN len({c}) > 0 THEN {_Q(label + ': ')} || array_to_string({c}, ', ') END"
_files = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else _Q(x) for x in r) + ")" for r in FILES) + ") f(name, content_type, status, method, done, pages, error, next_try, updated_at))"
_at = lambda c: f"epoch(TRY_CAST({c} AS TIMESTAMP))"
ORACLE = {
    "enriched_questions": f"""
WITH {_PLANS}, q AS (SELECT p.*, query, list_distinct(regexp_extract_all(normalised, '\\b(20\\d{{2}})\\b', 1)) AS years FROM plans p JOIN {derived_values('queries')} USING (qid))
SELECT qid, CASE WHEN NOT asks OR cites THEN trim(query) ELSE trim(left(trim(query) || {_Q(_HEAD)} || concat_ws('; ', {_part('lĩnh vực', 'areas')}, {_part('đối tượng', 'subjects')}, {_part('nghiệp vụ', 'intents')}, coalesce({_part('thời kỳ người dùng nêu', 'years')}, 'áp dụng tại ngày 21/07/2026')) || {_Q(_TAIL)}, 490)) END AS question FROM q""",
    "guarded_responses": f"""
WITH r AS (SELECT *, status IN ('expired', 'repealed') OR relevance < 1.4 AS blocked, conflict AND NOT verified AS open FROM {derived_values('statuses')}, (VALUES (true), (false)) s(shell), (VALUES (true), (false)) c(conflict), (VALUES (true), (false)) v(verified), (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) r(relevance))
SELECT doc, status, shell, conflict, verified, relevance, CASE WHEN status IN ('expired', 'repealed') THEN status WHEN relevance < 1.4 THEN 'irrelevant' WHEN shell THEN 'shell' WHEN open THEN 'conflict' END AS reason,
  NOT blocked AND NOT shell AS shown, CASE WHEN blocked OR open THEN 0.38::DOUBLE WHEN shell THEN 0.55::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM r""",
    "recent_candidates": f"SELECT cid, coalesce(CAST(issued_date AS DATE) BETWEEN DATE '2026-07-21' - 120 AND DATE '2026-07-21', contains(document_number, '/2026/'), false) AS recent FROM {derived_values('candidates')}",
    "scheduled_files": f"""
SELECT name, CASE WHEN NOT (contains(content_type, 'pdf') OR ends_with(lower(name), '.pdf')) OR status IN ('ready', 'unsupported') THEN false WHEN {_at('next_try')} > epoch(TIMESTAMP '2026-07-20 12:00:00') THEN false
  WHEN status = 'processing' THEN coalesce(epoch(TIMESTAMP '2026-07-20 12:00:00') - {_at('updated_at')} >= 270, true)
  WHEN status = 'ocr_partial' OR (status = 'failed' AND regexp_matches(coalesce(error, ''), '429|quota|rate limit|resource exhausted|too many requests|timeout|fetch failed|network', 'i')) THEN true ELSE coalesce(method = 'pdf_ocr' AND done < pages, false) END AS run FROM {_files}""",
    "matching_sheet": f"""
WITH w AS (SELECT DISTINCT {D.header_key('n_name')} AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), s AS (SELECT DISTINCT c_mktsegment AS sheet, {D.header_key('n_name')} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT sheet, count(*) AS shared FROM s JOIN w USING (name) GROUP BY sheet)
SELECT sheet, shared FROM m WHERE shared >= greatest(2, ceil(least((SELECT count(*) FROM w), 8) * 0.4)) ORDER BY shared DESC, sheet LIMIT 1""",
}
