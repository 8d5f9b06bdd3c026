"""Document-ETL queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import etl as E
from quillon.plans.fixtures import derived, derived_values
from quillon.plans.retrieval import table

_Q = D.quote
SIGNALS = ["the", "nd", "ing", "que", "der", "con"]
MARKERS = r"\b(?:The|Les|Der|Los)\s+[a-z]+"
ACCENTS = "[àâäçéèêëîïôöùûüßñáíóú]"
SUSPICIOUS = r"[�□■◆◇]|\?{2,}|[#$%&*]{3}"
CATEGORIES = {"licence": r"licen[cs]e", "address": r"[a-z0-9._]+@[a-z0-9.]+", "number": r"\d{6}", "title": r"\bthe\b", "question": r"\?"}


def portal_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = E.signal_count(F.col("text"), SIGNALS)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("signals"), (n >= 4).alias("shell"), ((F.length("text") >= 800) & (n < 4)).alias("usable"))


def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("method", F.element_at(F.array(*map(F.lit, ["ocr", "docx", "doc", "pdf_text", "html", "ocr_required", "plain"])), (F.col("doc_id") % 7 + 1).cast("int")))
    docs = docs.select("doc_id", "method", "text", T.once(T.tidy(F.col("text"))).alias("clean"))
    return docs.select("doc_id", "method", F.round(E.extraction_score(F.col("text"), F.col("method"), MARKERS), 6).alias("score"), F.round(E.readability_score(F.col("clean"), MARKERS, ACCENTS, SUSPICIOUS), 6).alias("readability"))


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.neighbour_similarity(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return rows.withColumn("jaccard", F.round("jaccard", 6)).withColumn("overlap", F.round("overlap", 6))


def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.drop_repeated_edges(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def labelled_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive labelled documents, by label."""
    return E.ranges(table(spark, sf_dir, "labels"), "toxic", "doc_id")


def turn_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3)


def page_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.page_selection(derived(spark, sf_dir, "selections"), "sid", "pages")


def article_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.articles(derived(spark, sf_dir, "provisions"), "doc", "text")


def official_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "dates").select("did", E.official_date(F.col("text")).alias("day"))


def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_metadata(derived(spark, sf_dir, "metadata"))


def best_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_draft(derived(spark, sf_dir, "drafts"))


def category_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.coverage(table(spark, sf_dir, "documents"), "doc_id", "text", CATEGORIES)
    return rows.select("doc_id", F.array_join("shown", ",").alias("shown"), F.array_join("missing", ",").alias("missing"), "score")


def cleaned_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, among which some got a stamp, a signature's label, the words of a logo or a page number."""
    k = F.col("doc_id")
    head = F.when(k % 3 == 0, "SAO Y; Bộ Tài chính; 02/04/2026; 17:08:02; +07:00\n").when(k % 3 == 1, "Người ký: Nguyễn Văn A\n").otherwise("SAO Y; không có ngày giờ\n")
    tail = F.when(k % 4 == 0, "\ncuối trang LOGO").when(k % 4 == 1, "\n(LOGO) cuối WATERMARK trang , hết").when(k % 4 == 2, F.concat(F.lit("\ntrang "), (1 + k % 99).cast("string"))).otherwise("\nLOGOS và logo-type")
    return E.artifact_lines(table(spark, sf_dir, "documents").withColumn("text", F.concat(head, F.coalesce("text", F.lit("")), tail)), "doc_id", "text")


def validated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("page", F.col("turn") + 1).withColumn("score", F.least(F.lit(1.0), F.length("text") / 400.0))
    return E.validate_pages(turns, "conv_id", "page", "text", "score")


def completed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where(F.length("text") >= 60)
    return E.first_missing(turns, "conv_id", "turn")


def evidence_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.evidence_window(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text").contains("that"))
    return rows.select("conv_id", "turn", "hit")


def notification_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.classify_notifications(derived(spark, sf_dir, "published")).select("revision", "reason", "eligible", "freshness")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph counts and a digest of the ordered paragraphs of every document."""
    parts = F.filter(F.transform(F.split(T.tidy(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).cast("long").alias("longest"), F.md5(F.array_join(parts, "|")).alias("parts_md5"))


QUERIES = {f.__name__: f for f in (portal_signals, extraction_scores, turn_similarity, repeated_edges, labelled_ranges, turn_batches, page_selections, article_parts, official_dates, merged_metadata, best_drafts, category_coverage, cleaned_artifacts, validated_pages, completed_prefix, evidence_neighbours, notification_classes, paragraphs)}

_HEAD = D.squeeze(D.fold("left(text, 12000)"))
_SIGNALS = " + ".join(f"contains(h, {_Q(s)})::INTEGER" for s in SIGNALS)


def _count(p: str, x: str = "t", options: str = "") -> str:
    return f"len(regexp_extract_all({x}, {_Q(p)}, 0{', ' + _Q(options) if options else ''}))"


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


_TOKENS = f"list_distinct(list_filter(regexp_split_to_array({D.fold('text')}, '[^a-z0-9]+'), lambda t: length(t) >= 1))"
_LINES = f"list_filter(list_transform(string_split({D.tidy('text')}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_EDGE = f"trim(regexp_replace(regexp_replace({D.fold('line')}, '\\d+', '#', 'g'), '[^a-z#]+', ' ', 'g'))"


def _date(p: str, y: int, m: int, d: int, options: str = "") -> str:
    o = f", {_Q(options)}" if options else ""
    g = lambda n: f"regexp_extract(text, {_Q(p)}, {n}{o})"
    return f"strftime(TRY_CAST({g(y)} || '-' || lpad({g(m)}, 2, '0') || '-' || lpad({g(d)}, 2, '0') AS DATE), '%Y-%m-%d')"


_ART = E.ARTICLE[6:]
_SIG = lambda text, signals: "len(list_filter([" + ", ".join(map(_Q, signals)) + f"], lambda s: contains({text}, s)))"

ORACLE = {
    "portal_signals": f"SELECT doc_id, {_SIGNALS} AS signals, {_SIGNALS} >= 4 AS shell, length(text) >= 800 AND {_SIGNALS} < 4 AS usable FROM (SELECT doc_id, text, {_HEAD} AS h FROM documents)",
    "extraction_scores": f"""
WITH a AS (SELECT doc_id, text, {D.tidy('text')} AS t, list_extract(['ocr', 'docx', 'doc', 'pdf_text', 'html', 'ocr_required', 'plain'], doc_id % 7 + 1) AS method FROM documents)
SELECT doc_id, method, round(CASE WHEN method = 'ocr_required' THEN 0.2::DOUBLE ELSE {_clamp(f"CASE method WHEN 'ocr' THEN 0.6::DOUBLE WHEN 'docx' THEN 0.58::DOUBLE WHEN 'doc' THEN 0.56::DOUBLE WHEN 'pdf_text' THEN 0.52::DOUBLE WHEN 'html' THEN 0.42::DOUBLE ELSE 0.5::DOUBLE END + least(1.0::DOUBLE, length(text) / 8000.0::DOUBLE) * 0.2::DOUBLE + least(1.0::DOUBLE, {_count(MARKERS, 'text')} / 8.0::DOUBLE) * 0.22::DOUBLE - {_count('�', 'text')}::DOUBLE / greatest(1, length(text)) * 20")} END, 6) AS score,
  round(CASE WHEN length(t) = 0 THEN 0::DOUBLE ELSE {_clamp(f"0.08::DOUBLE + {_clamp('length(t) / 1400.0::DOUBLE')} * 0.25::DOUBLE + {_clamp(_count(MARKERS) + ' / 5.0::DOUBLE')} * 0.26::DOUBLE + {_clamp(_count(ACCENTS) + ' / 24.0::DOUBLE')} * 0.15::DOUBLE + {_clamp(_count('[' + chr(92) + 'pL' + chr(92) + 'd]') + '::DOUBLE / greatest(1, length(t)) / 0.72::DOUBLE')} * 0.16::DOUBLE + {_clamp('len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) >= 8)) / 12.0::DOUBLE')} * 0.1::DOUBLE - {_clamp(_count(SUSPICIOUS) + '::DOUBLE * 4 / greatest(20, length(t)) * 8')} * 0.35::DOUBLE")} END, 6) AS readability FROM a""",
    "turn_similarity": f"""
WITH a AS (SELECT conv_id, turn, {_TOKENS} AS x FROM conversations), b AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM a)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard, round(len(list_intersect(x, y))::DOUBLE / greatest(1, len(x), len(y)), 6) AS overlap FROM b WHERE y IS NOT NULL""",
    "repeated_edges": f"""
WITH a AS (SELECT conv_id, turn, {_LINES} AS l FROM conversations),
b AS (SELECT conv_id, turn, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM a),
c AS (SELECT *, {_EDGE} AS key FROM b),
o AS (SELECT conv_id, key FROM c WHERE (pos < 2 OR pos >= n - 2) AND length(key) BETWEEN 3 AND 90 GROUP BY conv_id, key
  HAVING (SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id) >= 2 AND count(DISTINCT turn) >= greatest(2, ceil((SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id) * 0.67::DOUBLE))),
k AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY pos) AS t FROM c ANTI JOIN o USING (conv_id, key) GROUP BY ALL)
SELECT conv_id, turn, length(coalesce(t, ''))::INTEGER AS n_chars, md5(coalesce(t, '')) AS text_md5 FROM conversations LEFT JOIN k USING (conv_id, turn)""",
    "labelled_ranges": 'SELECT toxic, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT toxic, doc_id, doc_id - row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS island FROM (SELECT DISTINCT toxic, doc_id FROM labels)) GROUP BY toxic, island',
    "turn_batches": "SELECT conv_id, CAST(floor((r - 1) / 3) AS BIGINT) AS batch, count(*) AS n, min(turn) AS first, max(turn) AS last FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id, batch",
    "page_selections": f"""
WITH a AS (SELECT sid, unnest(regexp_split_to_array(regexp_replace(pages, '\\s*[-–—]\\s*', '-', 'g'), '[,;\\s]+')) AS p FROM {derived_values('selections')}),
b AS (SELECT sid, regexp_extract(p, '^(\\d{{1,4}})', 1)::INTEGER AS x, regexp_extract(p, '(\\d{{1,4}})$', 1)::INTEGER AS y FROM a WHERE regexp_matches(p, '^\\d{{1,4}}(-\\d{{1,4}})?$'))
SELECT sid, array_to_string(list_sort(list_distinct(list(p))), ',') AS pages FROM (SELECT sid, unnest(range(least(x, y), greatest(x, y) + 1)) AS p FROM b) WHERE p >= 1 GROUP BY sid""",
    "article_parts": f"""
WITH a AS (SELECT doc, string_split(regexp_replace({D.tidy('text')}, {_Q('(?im)' + _ART)}, chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g'), chr(1)) AS p FROM {derived_values('provisions')}),
b AS (SELECT doc, len(p) AS n, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS pos FROM a), c AS (SELECT *, lead(part) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM b)
SELECT doc, 'article' AS kind, split_part(part, chr(2), 1) AS article, nullif(trim(split_part(part, chr(2), 2)), '') AS heading, {D.tidy('nxt')} AS body, CAST((pos + 1) / 2 * 100 AS INTEGER) AS order_index FROM c WHERE pos % 2 = 1
UNION ALL SELECT doc, CASE WHEN n = 1 THEN 'other' ELSE 'preamble' END, NULL, NULL, {D.tidy('part')}, 0 FROM c WHERE pos = 0 AND {D.tidy('part')} <> ''""",
    "official_dates": f"SELECT did, coalesce({_date(chr(92) + 'b(20' + chr(92) + 'd{2})-(' + chr(92) + 'd{1,2})-(' + chr(92) + 'd{1,2})' + chr(92) + 'b', 1, 2, 3)}, {_date(chr(92) + 'b(' + chr(92) + 'd{1,2})[/.-](' + chr(92) + 'd{1,2})[/.-](20' + chr(92) + 'd{2})' + chr(92) + 'b', 3, 2, 1)}, {_date(chr(92) + 'bng[àÀ]y' + chr(92) + 's+(' + chr(92) + 'd{1,2})' + chr(92) + 's+th[áÁ]ng' + chr(92) + 's+(' + chr(92) + 'd{1,2})' + chr(92) + 's+n[ăĂ]m' + chr(92) + 's+(20' + chr(92) + 'd{2})' + chr(92) + 'b', 3, 2, 1, 'i')}) AS day FROM {derived_values('dates')}",
    "merged_metadata": f"SELECT number, {', '.join(f'arg_max({c}, authority * 1000 - ord) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in ('title', 'issued', 'effective'))} FROM {derived_values('metadata')} GROUP BY number",
    "best_drafts": f"""SELECT page, pass, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (pass <> 'consensus')::INTEGER, length(text) DESC, pass) AS nth FROM (SELECT *, max(score) OVER (PARTITION BY page) AS best FROM {derived_values('drafts')}) WHERE best - score <= 0.015::DOUBLE + 1e-12) WHERE nth = 1""",
    "category_coverage": f"""
WITH a AS (SELECT doc_id, {D.fold('text')} AS f FROM documents),
b AS (SELECT doc_id, f, list_filter(regexp_split_to_array(f, '[.\\n]'), lambda s: length(trim(s)) >= 35) AS l FROM a),
c AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN regexp_matches(f, {_Q(p)}) THEN {_Q(n)} END" for n, p in CATEGORIES.items())}], lambda x: x IS NOT NULL) AS shown, list_filter([{', '.join(f"CASE WHEN len(list_filter(l, lambda s: regexp_matches(s, {_Q(p)}))) > 0 THEN {_Q(n)} END" for n, p in CATEGORIES.items())}], lambda x: x IS NOT NULL) AS held FROM b)
SELECT doc_id, array_to_string(shown, ',') AS shown, array_to_string(list_filter(shown, lambda x: NOT list_contains(held, x)), ',') AS missing, CASE WHEN len(shown) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(shown, lambda x: list_contains(held, x)))::DOUBLE / len(shown), 3) END AS score FROM c""",
    "cleaned_artifacts": f"""
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'SAO Y; Bộ Tài chính; 02/04/2026; 17:08:02; +07:00' WHEN 1 THEN 'Người ký: Nguyễn Văn A' ELSE 'SAO Y; không có ngày giờ' END || chr(10) || coalesce(text, '')
  || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'cuối trang LOGO' WHEN 1 THEN chr(10) || '(LOGO) cuối WATERMARK trang , hết' WHEN 2 THEN chr(10) || 'trang ' || (1 + doc_id % 99) ELSE chr(10) || 'LOGOS và logo-type' END AS text FROM documents),
a AS (SELECT doc_id, list_transform(string_split({D.tidy('text')}, chr(10)), lambda x: trim(x)) AS l FROM t),
b AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(line, {_Q(E.STAMP.replace('(?iu)', '(?i)'))}) AND regexp_matches(line, {_Q(E.STAMP_DAY)}) AND regexp_matches(line, {_Q(E.STAMP_TIME)}) OR regexp_matches(line, {_Q(E.SIGNED_BY.replace('(?iu)', '(?i)'))}) THEN 'certification_metadata'
  WHEN regexp_matches(line, '^(?:scanned by|scan by|camscanner|adobe scan|microsoft lens)\\b', 'i') THEN 'scanner_metadata'
  WHEN regexp_matches(line, '^[\\s_─━—–\\-=*·•.]{{5,}}$') THEN 'decorative_lines' WHEN (pos <= 2 OR pos >= n - 3) AND regexp_matches(line, '^(?:(?:trang|page)\\s*)?\\d{{1,4}}(?:\\s*[/|]\\s*\\d{{1,4}})?\\.?$', 'i') THEN 'page_numbers' END AS flag FROM b),
d AS (SELECT *, CASE WHEN flag IS NULL THEN len(regexp_extract_all(line, '(?i)(?:^|[\\s(\\[{{:;,-])LOGO(?:$|[\\s)\\]}}:;,.!?-])')) + len(regexp_extract_all(line, '(?i)\\bWATERMARK\\b')) ELSE 0 END AS tokens,
  CASE WHEN flag IS NULL THEN trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '(?i) LOGO($|[\\s)\\]}}:;,.!?-])', ' \\1', 'g'), '(?i)(?:^|[\\s(\\[{{:;,-])LOGO($|[\\s)\\]}}:;,.!?-])', '\\1', 'g'), '(?i)\\bWATERMARK\\b', '', 'g'), ' {{2,}}', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g')) END AS rest FROM c)
SELECT doc_id, count(flag) AS removed, CAST(sum(tokens) AS BIGINT) AS tokens, array_to_string(list_sort(list_concat(coalesce(list(DISTINCT flag) FILTER (WHERE flag IS NOT NULL), []), CASE WHEN sum(tokens) > 0 THEN ['logo_or_watermark'] ELSE [] END)), ',') AS flags,
  md5(coalesce(string_agg(rest, chr(10) ORDER BY pos) FILTER (WHERE rest <> ''), '')) AS kept_md5 FROM d GROUP BY doc_id""",
    "validated_pages": """
WITH a AS (SELECT conv_id, turn + 1 AS page, text, least(1.0::DOUBLE, length(text) / 400.0::DOUBLE) AS score FROM conversations),
b AS (SELECT conv_id, max(page) AS total, coalesce(list(DISTINCT page) FILTER (WHERE length(trim(text)) >= 40), []) AS covered, min(score) AS lowest FROM a GROUP BY conv_id),
c AS (SELECT *, list_filter(range(1, greatest(1, total) + 1), lambda x: NOT list_contains(covered, x)) AS missing FROM b)
SELECT conv_id, total, CAST(len(covered) AS INTEGER) AS n_covered, array_to_string(missing, ',') AS missing, round(lowest, 6) AS lowest, concat_ws(',', CASE WHEN len(missing) > 0 THEN 'pages' END, CASE WHEN lowest < 0.62 THEN 'score' END) AS warnings FROM c""",
    "completed_prefix": "SELECT conv_id, count(*) FILTER (WHERE r - 1 = turn) AS prefix FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE length(text) >= 60)) GROUP BY conv_id",
    "evidence_neighbours": "SELECT conv_id, turn, hit FROM (SELECT *, hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS near FROM (SELECT conv_id, turn, contains(text, 'that') AS hit FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE near",
    "notification_classes": f"""
WITH a AS (SELECT *, {D.normalise_plain('title', 'a-z0-9')} AS t, {D.normalise_plain("coalesce(body, '')", 'a-z0-9')} AS b, {D.normalise_plain("coalesce(kind, '')", 'a-z0-9')} AS k FROM {derived_values('published')}),
c AS (SELECT *, CASE WHEN {_SIG('t', E.EXCLUDED)} > 0 THEN 'excluded_topic' WHEN {_SIG('t', E.TITLE_SIGNALS)} > 0 OR regexp_matches(t, '(?:^|\\s)thue(?:\\s|$)') THEN 'tax_title'
  WHEN regexp_matches(k || ' ' || t, 'luat|nghi dinh|thong tu|nghi quyet|quyet dinh|van ban') AND {_SIG('b', E.CONTENT_SIGNALS)} >= 2 THEN 'tax_content' ELSE 'insufficient_tax_evidence' END AS reason FROM a)
SELECT revision, reason, reason IN ('tax_title', 'tax_content') AS eligible, CASE WHEN epoch(CAST(published AS TIMESTAMPTZ)) - epoch(CAST(issued || 'T00:00:00Z' AS TIMESTAMPTZ)) <= 259200 THEN 'fresh_document' ELSE 'backfilled_full_text' END AS freshness FROM c""",
    "paragraphs": f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n, CAST(coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS longest, md5(array_to_string(l, '|')) AS parts_md5 FROM (SELECT doc_id, {_LINES} AS l FROM documents)",
}
