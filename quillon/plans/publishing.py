"""Queries of validators, blocks and answers before publication, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import etl as E
from quillon.operators import publishing as P
from quillon.plans import etl
from quillon.plans.fixtures import derived, derived_values, frame, values
from quillon.plans.retrieval import table

_Q = D.quote


def cleaned_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as evidence, as speech, without control characters and without transcript wrappers."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.lower(T.squeeze(text))).alias("evidence_md5"), F.md5(P.strip(T.replace_all(text, P.SPEECH_RULES))).alias("speech_md5"),
        F.md5(T.replace_all(text, P.CONTROL_RULES)).alias("control_md5"), F.md5(P.strip(T.replace_all(text, P.WRAPPER_RULES))).alias("wrapper_md5"))


def spoken_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return derived(spark, sf_dir, "transcripts").select("tid", P.strip(T.replace_all(text, P.SPEECH_RULES)).alias("speech"), T.replace_all(text, P.CONTROL_RULES).alias("control"), P.strip(T.replace_all(text, P.WRAPPER_RULES)).alias("wrapper"))


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "text_drafts").withColumn("text", F.concat("head", F.expr("repeat('nội dung thuế ', filler)")))


def usable_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.usable_texts(_drafts(spark, sf_dir), "case_id", P.strip(F.col("text")), "expected")


def validated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived(spark, sf_dir, "draft_pages").withColumn("text", F.expr("repeat('x', chars)"))
    return P.validate_texts(_drafts(spark, sf_dir), pages, "case_id")


def legal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents."""
    rows = P.legal_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "first_line", "kind", F.md5("text").alias("text_md5"))


def clause_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.legal_blocks(derived(spark, sf_dir, "clauses"), "doc", "text")


def candidate_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "candidates").select("cid", P.year_score(F.col("issued_date"), 2026).alias("year_score"), P.amendment_score(F.concat_ws(" ", "title", "snippet")).alias("amendment_score"))


def best_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best turns of all conversations, one for a conversation and role, by their count of the word 'the'."""
    rows = table(spark, sf_dir, "conversations").withColumn("score", P.count(F.lower("text"), r"\bthe\b"))
    return P.best_provisions(rows, "conv_id", "role", "turn", "text", "score")


def latest_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest_update(derived(spark, sf_dir, "updates"), "target")


def response_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    return derived(spark, sf_dir, "warned").select("wid", F.array_join(P.merged_warnings(split("found"), split("checked")), "|").alias("warnings"))


def speech_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all conversations from the turn on that the conversation's number asks for."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", r"\. ").alias("parts"), (F.col("conv_id") % 4 - 1 + 0.5).alias("start"))
    return P.speech_queue(rows, "conv_id", "turn", "parts", "start").select("conv_id", "turn", "chunk", F.md5("text").alias("text_md5"))


def scene_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = derived(spark, sf_dir, "scenes").select("scene", F.split("ids", r"\|").alias("ids"))
    return P.points_of(scenes, frame(spark, "scene_claims"), "ids", "point").select("scene", "place", "point", "claim")


def header_invoice_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "invoice_sheets").select("sid", P.invoice_key(F.split("headers", r"\|"), F.split("cells", r"\|")).alias("key"))


def state_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = derived(spark, sf_dir, "lookup_states").select("number", F.explode(F.filter(F.split("gaps", ","), lambda x: x != "").cast("array<int>")).alias("page"))
    return P.answers_by_state(derived(spark, sf_dir, "lookup_states"), missing, "number", "page")


def video_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "video_rows").withColumn("text", F.expr("repeat('x', chars)"))
    return P.video_decision(rows, "2026-08-01T00:00:00Z").select("rid", "reason")


def notify_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published texts that still may be announced: about tax, issued from sixty days ago until tomorrow."""
    rows = E.classify_notifications(derived(spark, sf_dir, "published"))
    age = F.unix_timestamp(F.lit("2026-07-28 00:00:00").cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(F.concat("issued", F.lit("T00:00:00Z"))))
    return rows.select("revision", (F.col("eligible") & F.coalesce(age.between(-86_400, 60 * 86_400), F.lit(False))).alias("notify"))


QUERIES = {f.__name__: f for f in (cleaned_variants, spoken_texts, usable_drafts, validated_texts, legal_blocks, clause_blocks, candidate_boosts, best_provisions, latest_updates, response_warnings, speech_queue, scene_points, header_invoice_keys, state_answers, video_decisions, notify_window)}


def _re(pattern: str) -> str:
    """A pattern for DuckDB, whose letters fold beyond ASCII without a flag."""
    return pattern.replace("(?imu)", "(?im)").replace("(?iu)", "(?i)")


def _chain(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        by = by.replace("$1", "\\1")
        x = f"regexp_replace({x}, {_Q(_re(pattern))}, {_Q(by)}, 'g')"
    return x


_strip = lambda x: f"regexp_replace({x}, '^{T.JS_SPACE}+|{T.JS_SPACE}+$', '', 'g')"
_count = lambda x, p: f"len(regexp_extract_all({x}, {_Q(_re(p))}))"
_shell = lambda x: "(" + " + ".join([f"regexp_matches(left({x}, 12000), {_Q(p)})::INT" for p in P.SHELL_WORDS] + [f"contains({D.squeeze(D.fold(f'left({x}, 12000)'))}, {_Q(p)})::INT" for p in P.SHELL_PHRASES]) + ") >= 4"
_drafts_sql = f"(SELECT *, {_strip('''coalesce(head || repeat('nội dung thuế ', filler), '')''')} AS text FROM {derived_values('text_drafts')})"
_dates = " OR ".join(f"contains(head, {x})" for x in [
    "strftime(d, '%-d/%-m/%Y')", "strftime(d, '%d/%m/%Y')", *(f"strftime(d, 'ngay {a} thang {b} nam %Y')" for a in ("%-d", "%d") for b in ("%-m", "%m"))])
_blocks = lambda source, key: f"""
WITH l AS (SELECT {key}, unnest(range(len(a))) AS nth, {D.squeeze('unnest(a)')} AS line FROM (SELECT {key}, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', '\n', 'g'), '[\t\xa0]+', ' ', 'g'), chr(10)) AS a FROM {source})),
p AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY {key} ORDER BY nth), '') AS before, regexp_matches(line, {_Q(_re(P.ONLY_MARKER))}) AS marker FROM l),
o AS (SELECT *, marker OR before = '' OR (regexp_matches(line, {_Q(_re(P.OPENS_BLOCK))}) AND NOT regexp_matches(before, {_Q(_re(P.ONLY_MARKER))})) AS opens FROM p),
b AS (SELECT *, sum(opens::INT) OVER (PARTITION BY {key} ORDER BY nth) AS block, CASE WHEN marker THEN CASE WHEN regexp_matches(line, '^[0-9]') THEN 'clause' ELSE 'point' END WHEN regexp_matches(line, {_Q(P.BLOCK_HEAD)}) THEN 'heading' WHEN regexp_matches(line, {_Q(P.CLAUSE)}) THEN 'clause' WHEN regexp_matches(line, {_Q(_re(P.POINT))}) THEN 'point' ELSE 'paragraph' END AS kind FROM o)
SELECT {key}, min(nth) AS first_line, arg_min(kind, nth) AS kind, string_agg(line, ' ' ORDER BY nth) AS text FROM b WHERE line <> '' GROUP BY {key}, block"""  # noqa: E731
_part = lambda p: f"list_position(list_transform(h, lambda x: regexp_matches({D.header_key('x')}, {_Q(p)})), true)"
_keys = list(P.INVOICE_HEADERS)
_whole = lambda names: " + ".join(f"({n})::INT" for n in names)

ORACLE = {
    "cleaned_variants": f"SELECT doc_id, md5(lower({D.squeeze('text')})) AS evidence_md5, md5({_strip(_chain('text', P.SPEECH_RULES))}) AS speech_md5, md5({_chain('text', P.CONTROL_RULES)}) AS control_md5, md5({_strip(_chain('text', P.WRAPPER_RULES))}) AS wrapper_md5 FROM documents",
    "spoken_texts": f"SELECT tid, {_strip(_chain('text', P.SPEECH_RULES))} AS speech, {_chain('text', P.CONTROL_RULES)} AS control, {_strip(_chain('text', P.WRAPPER_RULES))} AS wrapper FROM {derived_values('transcripts')}",
    "usable_drafts": f"SELECT case_id, length(text) >= 800 AND NOT ({_shell('text')}) AND contains({D.number_key('left(text, 20000)')}, {D.number_key('''coalesce(expected, '')''')}) AND ({_count('text', P.GATE_MARKS)} >= 2 OR (length(text) >= 5000 AND regexp_matches(text, {_Q(P.GATE_TYPES)}))) AS usable FROM {_drafts_sql}",
    "validated_texts": f"""
WITH g AS (SELECT case_id, list(DISTINCT page) FILTER (chars >= 40) AS good, min(coalesce(score, 0)) AS lowest, bool_or(similarity > 0 AND similarity < 0.72) AS apart FROM {derived_values('draft_pages')} GROUP BY case_id),
r AS (SELECT d.* EXCLUDE (head), {D.squeeze(D.fold('left(text, 20000)'))} AS head, TRY_CAST(issued AS DATE) AS d, lowest, apart, coalesce(total_pages, 0) AS total, {_count('text', P.LEGAL_MARKS)} AS marks, {_count('text', P.UNREADABLE)} AS unreadable, coalesce(len(list_filter(good, lambda p: p BETWEEN 1 AND coalesce(total_pages, 0))), 0) AS covered,
  list_transform(regexp_extract_all(regexp_replace(text, '[.:]$', ''), '(?im)^\\s*Điều\\s+(\\d+)[a-zA-Z]?\\s*[.:]', 1), lambda x: x::INT) AS numbers FROM {_drafts_sql} d LEFT JOIN g USING (case_id)),
w AS (SELECT *, list_filter([CASE WHEN length(text) < 800 THEN 'short' END, CASE WHEN {_shell('text')} THEN 'shell' END, CASE WHEN NOT contains({D.number_key('left(text, 30000)')}, {D.number_key('''coalesce(expected, '')''')}) THEN 'number' END, CASE WHEN NOT ({_dates}) THEN 'date' END,
  CASE WHEN marks < 2 AND NOT (length(text) >= 5000 AND regexp_matches(text, {_Q(P.LEGAL_TYPES)})) THEN 'structure' END, CASE WHEN quality < (CASE WHEN method = 'ocr' THEN 0.68 ELSE 0.54 END) THEN 'quality' END, CASE WHEN covered < total THEN 'pages' END, CASE WHEN lowest < 0.62 THEN 'page_score' END,
  CASE WHEN unreadable > greatest(2, ceil(greatest(1, total) * 0.15)) THEN 'unreadable' END, CASE WHEN apart THEN 'disagreement' END, CASE WHEN list_sort(numbers) <> numbers THEN 'order' END], lambda x: x IS NOT NULL) AS found FROM r)
SELECT case_id, array_to_string(found, ',') AS warnings, CASE WHEN len(found) = 0 THEN 'ready' ELSE 'needs_review' END AS status, length(text) AS n_chars, marks, covered, lowest FROM w""",
    "legal_blocks": f"SELECT doc_id, first_line, kind, md5(text) AS text_md5 FROM ({_blocks('documents', 'doc_id')})",
    "clause_blocks": _blocks(derived_values("clauses"), "doc"),
    "candidate_boosts": f"""
SELECT cid, CASE WHEN y <= 2021 THEN -0.55 WHEN y = 2026 THEN 3.2 WHEN y = 2025 THEN 1.7 WHEN y = 2024 THEN 0.7 ELSE 0 END::DOUBLE AS year_score,
  CASE WHEN regexp_matches(n, '\\b(?:sua doi bo sung|thay the|bai bo)\\b') THEN 2.2 WHEN regexp_matches(n, '\\b(?:quy dinh chi tiet|huong dan thi hanh)\\b') THEN 0.35 ELSE 0 END::DOUBLE AS amendment_score
FROM (SELECT cid, TRY_CAST(left(issued_date, 4) AS INT) AS y, {D.normalise_query('''concat_ws(' ', title, snippet)''')} AS n FROM {derived_values('candidates')})""",
    "best_provisions": f"""
WITH r AS (SELECT conv_id, role, turn, len(regexp_extract_all(lower(text), '\\bthe\\b')) AS score FROM conversations WHERE length({_strip('text')}) > 80),
d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY score DESC, turn) = 1) SELECT conv_id, role, score, turn FROM d ORDER BY score DESC, turn, conv_id, role LIMIT 3""",
    "latest_updates": f"SELECT target, source, coalesce(issued, '') AS issued FROM (SELECT *, CASE kind WHEN 'replacement' THEN 3 WHEN 'amendment' THEN 2 WHEN 'repeal' THEN 1 END AS rank FROM {derived_values('updates')}) WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY coalesce(issued, '') DESC, rank DESC, score DESC, source DESC) = 1",
    "response_warnings": f"""
WITH x AS (SELECT wid, n, w FROM (SELECT wid, unnest(range(len(a))) AS n, unnest(a) AS w FROM (SELECT wid, string_split(coalesce(found, '') || '|' || coalesce(checked, ''), '|') AS a FROM {derived_values('warned')})) WHERE w <> ''),
f AS (SELECT wid, w, min(n) AS n FROM x GROUP BY wid, w QUALIFY row_number() OVER (PARTITION BY wid ORDER BY min(n)) <= 5)
SELECT wid, coalesce(string_agg(w, '|' ORDER BY n), '') AS warnings FROM {derived_values('warned')} LEFT JOIN f USING (wid) GROUP BY wid""",
    "speech_queue": """
WITH c AS (SELECT *, string_split(text, '. ') AS a, max(turn) OVER (PARTITION BY conv_id) AS most FROM conversations)
SELECT conv_id, turn, unnest(range(len(a)))::INT AS chunk, md5(unnest(a)) AS text_md5 FROM c WHERE turn >= greatest(0, least(most, floor(conv_id % 4 - 1 + 0.5)))""",
    "scene_points": f"SELECT scene, place, point, claim FROM (SELECT scene, unnest(range(len(a)))::INT AS place, unnest(a) AS point FROM (SELECT scene, string_split(ids, '|') AS a FROM {derived_values('scenes')})) JOIN {values('scene_claims')} USING (point)",
    "header_invoice_keys": f"""
WITH s AS (SELECT sid, string_split(headers, '|') AS h, string_split(cells, '|') AS c FROM {derived_values('invoice_sheets')}), i AS (SELECT sid, c, {', '.join(f'coalesce({_part(p)}, 0) AS at_{k}' for k, p in P.INVOICE_HEADERS.items())} FROM s),
k AS (SELECT *, {', '.join(f"CASE WHEN at_{k} > 0 THEN {D.header_key(f'c[at_{k}]')} ELSE '' END AS v_{k}" for k in _keys)} FROM i)
SELECT sid, CASE WHEN {_whole([f'at_{k} > 0' for k in _keys])} >= 2 AND {_whole([f"v_{k} <> ''" for k in _keys])} >= 2 THEN {" || '|' || ".join(f'v_{k}' for k in _keys)} END AS key FROM k""",
    "state_answers": f"""
WITH s AS (SELECT *, CASE WHEN coalesce(accepted AND upper(revision_number) = upper(number), false) THEN 'ready' WHEN state IN ('processing', 'needs_review', 'failed') THEN state END AS answer FROM {derived_values('lookup_states')}),
p AS (SELECT DISTINCT number, TRY_CAST(unnest(string_split(gaps, ',')) AS INT) AS page FROM s), i AS (SELECT number, page, page - row_number() OVER (PARTITION BY number ORDER BY page) AS island FROM p WHERE page IS NOT NULL),
r AS (SELECT number, min(page) AS a, max(page) AS b, row_number() OVER (PARTITION BY number ORDER BY min(page)) AS n FROM i GROUP BY number, island),
t AS (SELECT number, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY n) FILTER (n <= 8) || CASE WHEN max(n) > 8 THEN ', …' ELSE '' END AS missing FROM r GROUP BY number)
SELECT number, answer, CASE answer WHEN 'ready' THEN 0.99 WHEN 'processing' THEN 0.82 WHEN 'needs_review' THEN 0.76 ELSE 0.58 END::DOUBLE AS confidence, CASE WHEN answer = 'ready' THEN '' ELSE coalesce(missing, '') END AS missing FROM s LEFT JOIN t USING (number) WHERE answer IS NOT NULL""",
    "video_decisions": f"""
SELECT rid, CASE WHEN NOT accepted THEN 'not_accepted' WHEN TRY_CAST(published AS TIMESTAMP) IS NULL OR TRY_CAST(published AS TIMESTAMP) < TIMESTAMP '2026-08-01' THEN 'before_rollout' WHEN issued IS NULL OR issued < '2026-08-01' THEN 'old_issued_document'
  WHEN NOT eligible THEN 'not_tax_document' WHEN chars < 1500 THEN 'insufficient_text' WHEN NOT capable THEN 'pipeline_not_ready' ELSE 'eligible' END AS reason FROM {derived_values('video_rows')}""",
    "notify_window": f"SELECT revision, eligible AND coalesce(TRY_CAST(issued AS DATE) BETWEEN DATE '2026-07-28' - 60 AND DATE '2026-07-28' + 1, false) AS notify FROM ({etl.ORACLE['notification_classes']}) c JOIN {derived_values('published')} p USING (revision)",
}
