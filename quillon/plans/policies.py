"""Queries of policies and sources, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import policies as P
from quillon.operators import retrieval as R
from quillon.plans.fixtures import derived, derived_values, frame, values
from quillon.plans.retrieval import ORACLE as HINTS
from quillon.plans.retrieval import table
from quillon.sources import readers as S

_Q = D.quote
CURRENT = ["108/2025/QH15", "89/2026/TT-BTC", "90/2026/TT-BTC", "90/2026/NĐ-CP", "123/2020/NĐ-CP", "80/2021/TT-BTC"]
RULES = [(1, "household threshold", [r"\bho kinh doanh\b", r"\bdoanh thu\b"]), (2, "refund file", [r"\bhoan thue\b", r"\bho so\b"]), (3, "rates", [r"\bthue suat\b"]), (4, "any tax", [r"\bthue\b"])]
NOTICES = [(1, "quota exceeded, retry in 12.5s"), (2, "retry in 3s; Retry in 90s"), (3, "no advice"), (4, "retry in 4.2s")]
PAYLOADS = [("70/2025/NĐ-CP", '{"data": [{"so_ky_hieu": "70/2025/NĐ-CP", "trich_yeu": "t", "danh_sach_tep_van_ban": [{"file_name": "a.pdf", "duong_dan": "u1"}, {"file_name": "a.docx", "duong_dan": "u2"}, {"file_name": "b.docx", "duong_dan": "u1"}]}, {"so_ky_hieu": "71/2025/NĐ-CP", "danh_sach_tep_van_ban": [{"file_name": "c.pdf", "duong_dan": "u3"}]}]}'), ("1/2026", "not json"), ("2/2026", '{"data": []}')]
RELATED = [("90/2026/NĐ-CP", "Nghị định này thay thế Nghị định 86/2024/ND-CP; bãi bỏ 12/2020/TT-BTC, 13/2020/TT-BTC\nsửa đổi, bổ sung 90/2026/NĐ-CP và 123/2020/NĐ-CP"), ("1/2026/TT-BTC", "không có gì")]


def _named(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql(rows: list, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _Q(x) for x in r) + ")" for r in rows) + f") v({names}))"


def backbone_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "queries").select("qid", F.array_join(P.backbone(T.normalise_query(F.col("query"))), ",").alias("numbers"))


def resolved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = R.search_hints(derived(spark, sf_dir, "queries").withColumn("query", T.clean_user_query(F.col("query"))))
    return P.unique_alias(hints, _named(spark, [(c,) for c in CURRENT], "current STRING"))


def verified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = derived(spark, sf_dir, "queries").select("qid", T.normalise_query(F.col("query")).alias("n"))
    return P.first_rule(asked, "qid", "n", _named(spark, RULES, "ordinal INT, answer STRING, patterns ARRAY<STRING>"))


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = derived(spark, sf_dir, "queries").unionByName(_named(spark, [(90, "Tờ khai 01/GTGT chỉ tiêu [37] và [38] năm 2025"), (91, "kê khai ô 22, 23, 22 theo 80/2021/TT-BTC")], "qid INT, query STRING"))
    return extra.select("qid", F.array_join(P.field_numbers(T.normalise_query(F.col("query"))).cast("array<string>"), ",").alias("fields"))


def disqualified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = frame(spark, "queries").select("qid", T.once(T.normalise_plain(F.col("query"))).alias("q")).select("qid", T.once(P.asked_of(F.col("q"))).alias("asked"))
    held = derived(spark, sf_dir, "candidates")
    held = held.select("cid", T.once(T.normalise_plain(F.concat_ws(" ", "title", "snippet"))).alias("c")).select("cid", T.once(P.held_by(F.col("c"))).alias("held"))
    return held.crossJoin(F.broadcast(asked)).select("qid", "cid", P.unfit(F.col("asked"), F.col("held")).alias("out"))


def guarded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = frame(spark, "queries").select("qid", T.normalise_plain(F.col("query")).alias("q"))
    return derived(spark, sf_dir, "answers").crossJoin(F.broadcast(asked)).select("qid", "aid", P.binary_guard(F.col("q"), F.col("answer"), F.lit(0.8)).alias("confidence"))


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, NOTICES, "nid INT, notice STRING").select("nid", P.retry_delay(F.col("notice")).alias("delay_ms"))


def grouped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.relations(_named(spark, RELATED, "number STRING, text STRING"), "number", "text")


def capital_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(T.tidy(F.col("text")), "\n")).alias("at", "line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(P.capitals_heading(F.trim("line")), 1)).alias("headings"))


def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(T.tidy(F.col("text")), "\n")).alias("at", "line"))
    return P.block_roles(lines, "doc_id", "at", "line").groupBy("key", "role").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").withColumn("page", F.col("turn") + 1).withColumn("text", F.concat_ws("\n", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Trang "), "page")), "text", F.when(F.col("turn") % 2 == 0, F.col("page").cast("string"))))
    return P.page_edge_markers(pages, "conv_id", "page", "text")


def best_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three turns of each conversation with the most distinct tokens."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return P.ranked_evidence(turns, "conv_id", "turn", F.size(T.significant_tokens(F.col("text"))), 3).select("conv_id", "turn", "score", "rank")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values harvested from JSON strings, by event type."""
    k = F.from_json("props", "k INT, url STRING")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.count_distinct(k).alias("values"))


def gazette_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gazette_attachments(_named(spark, PAYLOADS, "number STRING, payload STRING"), "number", "payload")


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of at most 160 characters, of every document, up to a sentence end where there is one."""
    return table(spark, sf_dir, "documents").select("doc_id", T.compact_excerpt(F.col("text"), 160).alias("excerpt"))


QUERIES = {f.__name__: f for f in (backbone_queries, resolved_aliases, verified_rules, form_fields, disqualified_sources, guarded_answers, retry_delays, grouped_relations, capital_headings, block_roles, page_markers, best_turns, event_props, gazette_files, excerpts)}

_N = D.normalise_query("query")
_has = lambda x, p: f"regexp_matches({x}, {_Q(p)})"
_BARE = f"regexp_replace(regexp_replace({_N}, {_Q(chr(92) + 'b' + chr(92) + 'd{1,4}' + chr(92) + 's*[/-]' + chr(92) + 's*20' + chr(92) + 'd{2}(?:' + chr(92) + 's*[/-]' + chr(92) + 's*[a-z0-9-]+)?' + chr(92) + 'b')}, ' ', 'g'), '\\b20\\d{{2}}\\b', ' ', 'g')".replace("{{", "{").replace("}}", "}")
_LINES = f"list_filter(list_transform(string_split({D.tidy('t')}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_MARK = lambda x: f"(regexp_matches({x}, '^(?:trang|page)\\s*\\d{{1,4}}(?:\\s*(?:/|of)\\s*\\d{{1,4}})?$', 'i') OR regexp_matches({x}, '^\\d{{1,4}}\\s*(?:/|of)\\s*\\d{{1,4}}$', 'i') OR regexp_matches({x}, '^[-–—•·]\\s*\\d{{1,4}}\\s*[-–—•·]$') OR regexp_matches({x}, '^(?:\\(\\s*\\d{{1,4}}\\s*\\)|\\[\\s*\\d{{1,4}}\\s*\\])$') OR coalesce(TRY_CAST(regexp_extract({x}, '^0*(\\d{{1,4}})$', 1) AS BIGINT) = page, false))"

ORACLE = {
    "backbone_queries": f"""
WITH a AS (SELECT qid, {_N} AS n FROM {derived_values('queries')}),
b AS (SELECT qid, u, row_number() OVER (PARTITION BY qid ORDER BY nth) AS r FROM (SELECT qid, u, min(nth) AS nth FROM (SELECT qid, unnest(l) AS u, generate_subscripts(l, 1) AS nth FROM (SELECT qid, list_concat({', '.join(f"CASE WHEN {_has('n', p)} THEN {numbers!r} ELSE [] END" for p, numbers in P.BACKBONE)}) AS l FROM a)) GROUP BY qid, u))
SELECT a.qid, coalesce(string_agg(u, ',' ORDER BY r), '') AS numbers FROM a LEFT JOIN b ON a.qid = b.qid AND r <= 4 GROUP BY a.qid""",
    "resolved_aliases": f"""
WITH h AS ({HINTS['query_hints']}), c AS (SELECT current, split_part(current, '/', 1) AS n, split_part(current, '/', 2) AS y, CASE WHEN regexp_matches(current, '/N[ĐD]-CP$') THEN 'Nghị định' WHEN regexp_matches(current, '/TT-') THEN 'Thông tư' WHEN regexp_matches(current, '/(?:QH|UBTVQH)\\d*$') THEN 'Luật' END AS k FROM (SELECT unnest({CURRENT!r}) AS current)),
f AS (SELECT qid, count(*) AS fitting, min(current) AS one FROM h JOIN c ON h.number = c.n AND (h.year IS NULL OR h.year = c.y) AND (h.type IS NULL OR h.type = c.k) GROUP BY qid)
SELECT qid, coalesce(fitting, 0) AS fitting, CASE WHEN fitting = 1 THEN one END AS resolved FROM h LEFT JOIN f USING (qid)""",
    "verified_rules": f"""
WITH a AS (SELECT qid, {_N} AS n FROM {derived_values('queries')}), r AS (SELECT * FROM (VALUES {', '.join(f"({o}, {_Q(a)}, [{', '.join(map(_Q, p))}])" for o, a, p in RULES)}) r(ordinal, answer, patterns))
SELECT qid, arg_min(answer, ordinal) AS answer, count(*) AS rules FROM a, r WHERE len(list_filter(patterns, lambda x: NOT regexp_matches(n, x))) = 0 GROUP BY qid""",
    "form_fields": f"""
WITH q AS (SELECT * FROM {derived_values('queries')} UNION ALL SELECT * FROM {_sql([(90, 'Tờ khai 01/GTGT chỉ tiêu [37] và [38] năm 2025'), (91, 'kê khai ô 22, 23, 22 theo 80/2021/TT-BTC')], 'qid, query')}),
a AS (SELECT qid, {_BARE} AS b FROM q), l AS (SELECT qid, CASE WHEN regexp_matches(b, '\\b(?:chi tieu|to khai|mau|bieu mau|ke khai|khau tru)\\b') THEN regexp_extract_all(b, '\\b(\\d{{1,3}})\\b', 1) ELSE [] END AS x FROM a),
e AS (SELECT qid, v, min(nth) AS nth FROM (SELECT qid, CAST(unnest(x) AS INTEGER) AS v, generate_subscripts(x, 1) AS nth FROM l) WHERE v > 0 AND v < 1000 GROUP BY qid, v)
SELECT q.qid, coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY nth), '') AS fields FROM q LEFT JOIN e ON q.qid = e.qid GROUP BY q.qid""",
    "disqualified_sources": f"""
WITH a AS (SELECT qid, {D.normalise_plain('query')} AS q FROM {values('queries')}), b AS (SELECT cid, {D.normalise_plain("concat_ws(' ', title, snippet)")} AS c FROM {derived_values('candidates')}),
m AS (SELECT qid, cid, q, c, regexp_matches(q, '\\b(?:sua doi|bo sung|thay the|bai bo|het hieu luc|doi chieu|diem moi|van ban nao bai bo)\\b') AS amends FROM a, b)
SELECT qid, cid, (regexp_matches(c, '\\b(?:bai bo toan bo|bai bo thong tu|bai bo quyet dinh|quy dinh viec bai bo|het hieu luc toan bo)\\b') AND NOT amends)
  OR (regexp_matches(c, '\\b86\\s*/\\s*2024\\s*/\\s*tt-btc\\b') AND NOT regexp_matches(q, '\\b(?:2024|2025|86\\s*/\\s*2024|thong tu\\s+(?:so\\s+)?86)\\b') AND NOT amends)
  OR (regexp_matches(q, '\\b(?:doanh nghiep|cong ty|to chuc|hop tac xa)\\b') AND regexp_matches(c, '\\b(?:ho kinh doanh|ca nhan kinh doanh)\\b') AND NOT regexp_matches(c, '\\b(?:doanh nghiep|cong ty|to chuc|nguoi nop thue)\\b')) AS out FROM m""",
    "guarded_answers": f"""
SELECT qid, aid, CASE WHEN regexp_matches(q, '\\b(?:co can|co phai|co duoc|co .* khong|phai khong|duoc khong)\\b') AND NOT (regexp_matches(h, '^(?:co|khong|co the|khong nhat thiet|chua the ket luan|chua du can cu)\\b') OR regexp_matches(h, '\\bket luan\\s*(?:co|khong|chua the ket luan)\\b')) THEN 0.45::DOUBLE ELSE 0.8::DOUBLE END AS confidence
FROM (SELECT qid, {D.normalise_plain('query')} AS q FROM {values('queries')}), (SELECT aid, {D.normalise_plain('left(answer, 320)')} AS h FROM {derived_values('answers')})""",
    "retry_delays": f"SELECT nid, CAST(greatest(5000, least(65000, CASE WHEN len(s) > 0 THEN ceil(list_max(s) * 1000) + 1500 ELSE 5000 END)) AS BIGINT) AS delay_ms FROM (SELECT nid, list_transform(regexp_extract_all(notice, 'retry in\\s+(\\d+(?:\\.\\d+)?)s', 1, 'i'), lambda x: CAST(x AS DOUBLE)) AS s FROM {_sql(NOTICES, 'nid, notice')})",
    "grouped_relations": f"""
WITH a AS (SELECT number, regexp_split_to_array(text, '[\\n;]+') AS l FROM {_sql(RELATED, 'number, text')}), b AS (SELECT number, unnest(l) AS clause, generate_subscripts(l, 1) AS pos FROM a),
c AS (SELECT *, {D.normalise_plain('clause', 'a-z0-9')} AS f FROM b), d AS (SELECT *, CASE WHEN regexp_matches(f, '\\bthay the\\b') THEN 'replaces' WHEN regexp_matches(f, '\\bbai bo\\b') THEN 'repeals' WHEN regexp_matches(f, '\\b(?:sua doi|bo sung)\\b') THEN 'amends' END AS kind FROM c),
e AS (SELECT number, kind, pos, unnest(x) AS found, generate_subscripts(x, 1) AS nth FROM (SELECT *, regexp_extract_all(clause, '(\\d{{1,4}}\\s*/\\s*20\\d{{2}}\\s*/\\s*[A-ZĐa-z0-9-]+)', 1) AS x FROM d WHERE kind IS NOT NULL)),
g AS (SELECT number, kind, t, min(pos * 1000 + nth) AS place FROM (SELECT *, {D.canonical_number('found')} AS t FROM e) WHERE t <> '' AND t <> number GROUP BY ALL)
SELECT number AS "of", kind, string_agg(t, ',' ORDER BY place) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY number, kind ORDER BY place) AS r FROM g) WHERE r <= 4 GROUP BY ALL""",
    "capital_headings": f"""
WITH a AS (SELECT doc_id, trim(unnest(string_split({D.tidy('text')}, chr(10)))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length(line) BETWEEN 8 AND 220 AND NOT regexp_matches(line, '[.!?;:]$') AND len(regexp_extract_all(line, '\\p{{L}}')) >= 5 AND len(regexp_extract_all(line, '\\p{{Lu}}'))::DOUBLE / greatest(1, len(regexp_extract_all(line, '\\p{{L}}'))) >= 0.86) AS headings FROM a GROUP BY doc_id""",
    "page_markers": f"""
WITH p AS (SELECT conv_id, turn + 1 AS page, concat_ws(chr(10), CASE WHEN turn % 3 = 0 THEN 'Trang ' || (turn + 1) END, text, CASE WHEN turn % 2 = 0 THEN CAST(turn + 1 AS VARCHAR) END) AS t FROM conversations),
a AS (SELECT conv_id, page, {_LINES} AS l FROM p), b AS (SELECT conv_id, page, CASE WHEN len(l) > 0 AND {_MARK('l[1]')} THEN l[2:] ELSE l END AS l FROM a), c AS (SELECT conv_id, page, CASE WHEN len(l) > 0 AND {_MARK('l[len(l)]')} THEN l[1:len(l) - 1] ELSE l END AS l FROM b)
SELECT conv_id, page, CAST(len(l) AS INTEGER) AS n_lines, md5(array_to_string(l, chr(10))) AS lines_md5 FROM c""",
    "best_turns": f"SELECT conv_id, turn, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM (SELECT conv_id, turn, len({D.significant_tokens('text')}) AS score FROM conversations)) WHERE rank <= 3",
    "event_props": """SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT k) AS "values" FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type""",
    "excerpts": f"""
SELECT doc_id, CASE WHEN length(c) <= 160 THEN c WHEN length(s) > 80 THEN left(h, length(s)) ELSE rtrim(h) || '…' END AS excerpt FROM (SELECT doc_id, c, left(c, 160) AS h, regexp_extract(left(c, 160), '^(.*[.;])\\s', 1, 's') AS s FROM (SELECT doc_id, {D.squeeze('text')} AS c FROM documents))""",
}
