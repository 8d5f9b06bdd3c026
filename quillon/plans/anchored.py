"""Anchored evidence over all documents, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import anchored as A
from quillon.plans.retrieval import table
from quillon.plans.search import _has, _lexical, _tokens

#: The stated questions; each document is anchored in one of them, by its id.
ASKED = [
    (0, "Theo Thông tư 80/2021/TT-BTC, chỉ tiêu [2] và [7] trên tờ khai the and attion là gì"), (1, "Phân tích điểm mới eauouon enpaeux leaux của Nghị định 70/2025/NĐ-CP"),
    (2, "heitü entepf stber 3 và 12 khấu trừ thế nào"), (3, "osbo ciónll asción"), (4, "Nghị định 15/2020/NĐ-CP"),
]
#: Lines of a provision.
LINES = 4


def segments(docs: DataFrame) -> DataFrame:
    """Lines of documents as chunks of provisions of four; every third line is numbered as a form's fields are."""
    lines = F.filter(F.split(T.tidy(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.trim(x) != "")
    rows = docs.select((F.col("doc_id") % len(ASKED)).cast("int").alias("qid"), F.col("doc_id").alias("cid"), F.posexplode(lines).alias("at", "line"))
    n = (F.col("at") + 1).cast("string")
    said = F.when(F.col("at") % 3 == 0, F.concat(F.lit("["), n, F.lit("] "), "line")).when(F.col("at") % 3 == 1, F.concat(F.lit("| "), n, F.lit(" | sửa đổi "), "line")).otherwise(F.col("line"))
    provision = F.floor(F.col("at") / LINES).cast("int")
    return rows.select("qid", "cid", provision.alias("provision"), (F.col("at") % LINES).alias("chunk"), F.concat(F.lit("Điều "), (provision + 1).cast("string")).alias("label"), said.alias("text"))


def anchored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twelve segments of every document for its question, seeds and their neighbours first."""
    rows = A.scored(segments(table(spark, sf_dir, "documents")), spark.createDataFrame(ASKED, "qid INT, query STRING"))
    return A.evidence(rows).select("qid", "cid", "place", "provision", "chunk", "hits", "score", "seed", "beside")


def anchored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six excerpts for each question, out of its documents' evidence."""
    rows = A.scored(segments(table(spark, sf_dir, "documents")), spark.createDataFrame(ASKED, "qid INT, query STRING"))
    return A.answers(A.evidence(rows)).select("qid", F.size("excerpts").alias("n"), F.md5(F.array_join("excerpts", "\n\n")).alias("excerpts_md5"))


QUERIES = {f.__name__: f for f in (anchored_evidence, anchored_answers)}

_Q = D.quote
#: What each question is about and which fields it asks for, written down by hand.
_MATTER = [
    (0, "chi tieu 2 va 7 tren to khai the and attion la gi", [2, 7]), (1, "phan tich diem moi eauouon enpaeux leaux cua", []), (2, "heitu entepf stber 3 va 12 khau tru the nao", [3, 12]),
    (3, "osbo cionll ascion", []), (4, "nghi dinh 15/2020/nd-cp", []),
]
_HIT = r"len(list_filter(fields, lambda f: regexp_matches(text, '(?:\[\s*' || f || '\s*\]|\bchỉ\s*tiêu\s*\[?\s*' || f || '\s*\]?\b|(?:^|\n|\|)\s*' || f || '\s*(?:\||[.)]|$))', 'i')))"
_SCORED = f"""
lines AS (SELECT doc_id, list_filter(string_split({D.tidy("coalesce(text, '')")}, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
each AS (SELECT doc_id AS cid, CAST(doc_id % {len(ASKED)} AS INTEGER) AS qid, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM lines),
parts AS (SELECT qid, cid, CAST(pos // {LINES} AS INTEGER) AS provision, CAST(pos % {LINES} AS INTEGER) AS chunk, 'Điều ' || (pos // {LINES} + 1) AS label,
  CASE pos % 3 WHEN 0 THEN '[' || (pos + 1) || '] ' || line WHEN 1 THEN '| ' || (pos + 1) || ' | sửa đổi ' || line ELSE line END AS text FROM each),
asked AS (SELECT qid, q, fields, {_tokens('q')} AS qt FROM (SELECT * FROM (VALUES {', '.join(f"({n}, {_Q(q)}, CAST([{', '.join(map(str, f))}] AS INTEGER[]))" for n, q, f in _MATTER)}) m(qid, q, fields))),
plain AS (SELECT p.*, a.* EXCLUDE (qid), {D.normalise_query("concat_ws(' ', label, text)")} AS c, {D.normalise_query('text')} AS n, {_HIT} AS hits FROM parts p JOIN asked a USING (qid)),
scored AS (SELECT qid, cid, provision, chunk, label, text, CAST(hits AS INTEGER) AS hits, round({_lexical('q', 'qt', 'c', _tokens('c'))} + CASE WHEN {_has('q', A.CHANGES)} AND {_has('c', A.CHANGED)} THEN 2.4::DOUBLE ELSE 0 END
  + CASE WHEN {_has('q', A.ANALYSIS)} AND {_has('c', A.SCOPE)} THEN 0.9::DOUBLE ELSE 0 END
  + CASE WHEN {_has('q', A.ASKS_FORM)} THEN CASE WHEN {_has('n', A.FORM)} THEN 1.1::DOUBLE ELSE 0 END + CASE WHEN {_has('text', A.FIELD)} THEN 0.9::DOUBLE ELSE 0 END ELSE 0 END + hits * {A.POINTS}, 6) AS score FROM plain),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, cid ORDER BY hits DESC, score DESC, provision, chunk) AS rank FROM scored),
seeds AS (SELECT *, hits > 0 AND rank <= {A.SEEDS} AS seed FROM ranked),
near AS (SELECT *, NOT seed AND (coalesce(lag(seed) OVER line, false) OR coalesce(lead(seed) OVER line, false)) AS beside FROM seeds WINDOW line AS (PARTITION BY qid, cid, provision ORDER BY chunk)),
taken AS (SELECT *, row_number() OVER (PARTITION BY qid, cid ORDER BY CASE WHEN seed OR beside THEN 0 ELSE 1 END, rank) AS nth, count(*) FILTER (WHERE seed OR beside) OVER (PARTITION BY qid, cid) AS must FROM near),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid, cid ORDER BY rank) AS INTEGER) AS place FROM taken WHERE nth <= greatest({A.SEGMENTS}, must)),
chosen AS (SELECT * FROM placed WHERE place <= {A.SEGMENTS})"""
_EXCERPT = "CASE WHEN length(s) <= 900 THEN s WHEN length(regexp_extract(left(s, 900), '(?s)^(.*[.;])\\s', 1)) > 421 THEN regexp_extract(left(s, 900), '(?s)^(.*[.;])\\s', 1) ELSE rtrim(left(s, 900)) || '…' END"

ORACLE = {
    "anchored_evidence": f"WITH {_SCORED} SELECT qid, cid, place, provision, chunk, hits, score, seed, beside FROM chosen",
    "anchored_answers": f"""
WITH {_SCORED}, once AS (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY hits DESC, score DESC, cid, provision, chunk) AS copy FROM chosen WHERE hits > 0 OR score > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, score DESC, cid, provision, chunk) AS nth_ FROM once WHERE copy = 1),
said AS (SELECT qid, nth_, label || chr(10) || {_EXCERPT} AS line FROM (SELECT *, {D.squeeze('text')} AS s FROM best WHERE nth_ <= {A.EXCERPTS}))
SELECT qid, CAST(count(*) AS INTEGER) AS n, md5(string_agg(line, chr(10) || chr(10) ORDER BY nth_)) AS excerpts_md5 FROM said GROUP BY qid""",
}
