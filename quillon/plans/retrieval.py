"""Retrieval queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import index as I
from quillon.operators import retrieval as R
from quillon.plans.fixtures import derived, derived_values, frame, table, values
from quillon.sources.shared import shared_folder


def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5"), F.md5(T.normalise_query(F.col("text"))).alias("query_md5"), F.md5(T.tidy(F.col("text"))).alias("tidy_md5"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.once(T.tokens_of(T.normalise_query(F.col("text")))).alias("tokens"))
    docs = docs.select("doc_id", "tokens", T.once(T.distinct_tokens(F.col("tokens"))).alias("distinct"))
    tokens, distinct = F.col("tokens"), F.col("distinct")
    return docs.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(distinct).cast("long").alias("n_distinct"), F.md5(F.array_join(F.array_sort(distinct), " ")).alias("tokens_md5"))


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "candidates")
    n = F.coalesce("document_number", "title")
    return rows.select("cid", T.number_key(n).alias("number_key"), T.storage_key(n).alias("storage_key"), T.slug(F.col("title")).alias("slug"), T.canonical_number(F.concat_ws(" ", "document_number", "title")).alias("canonical"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.canonical_url(F.col("url")).alias("canonical"), T.allowed_source(F.col("url"), ["m.ththth.example.net"], ["example.org"]).alias("allowed"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page in order, with the priority of attachment kinds; the best link first."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)=["']([^"']+)["']"""), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("at", "link"))
    kind = F.when(F.col("link").rlike(r"(?i)\.docx(?:$|\?)"), 0).when(F.col("link").rlike(r"(?i)\.doc(?:$|\?)"), 1).when(F.col("link").rlike(r"(?i)\.pdf(?:$|\?)"), 2).otherwise(3)
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.min_by("link", F.struct(kind, F.col("at"))).alias("best"))


def query_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search_hints(derived(spark, sf_dir, "queries").withColumn("query", T.clean_user_query(F.col("query")))).select("qid", "normalised", "type", "number", "year", "asks_question", "injection")


def query_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mentions(derived(spark, sf_dir, "queries"))


def query_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.references(derived(spark, sf_dir, "queries"))


def question_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = R.clarification(R.question_plans(derived(spark, sf_dir, "queries")))
    return plans.select("qid", "asks", "cites", F.array_join("areas", "; ").alias("areas"), F.array_join("subjects", "; ").alias("subjects"), F.array_join("intents", "; ").alias("intents"), "clarify")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "candidates").withColumn("body", F.concat_ws(" ", "document_number", "title", "snippet"))


def source_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_relevance(frame(spark, "queries"), _candidates(spark, sf_dir)).withColumn("relevance", F.round("relevance", 6))


def lexical_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_relevance(frame(spark, "queries"), _candidates(spark, sf_dir)).withColumn("relevance", F.round("relevance", 6))


#: A stated query set in the words of the synthetic documents.
ASKED = [(1, "the and attion to thanedble"), (2, "eauouon enpaeux leaux"), (3, "heitü entepf stber"), (4, "worthless licence apache"), (5, "osbo ciónll asción")]


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most relevant documents for each query, over all documents: the flagship. They are indexed first, and no pair is made that shares no token."""
    asked = spark.createDataFrame(ASKED, "qid INT, query STRING")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), F.col("text").alias("body"))
    found = I.search(I.build(docs, shared_folder(spark, "index")), asked, 10)
    return found.select("qid", F.col("cid").alias("doc_id"), F.round("relevance", 6).alias("relevance"), "rank")


def law_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = frame(spark, "queries").select("qid", R.time_intent(T.normalise_query(F.col("query")), 2026).alias("intent"))
    return R.law_decision(derived(spark, sf_dir, "statuses").crossJoin(F.broadcast(asked))).select("qid", "doc", "intent", "reason", "allowed")


def answer_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grounding_issues(derived(spark, sf_dir, "answers")).select("aid", F.array_join("unsupported", " ").alias("unsupported"), "missing_reference")


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = derived(spark, sf_dir, "candidates", True)
    return R.merge_best([every.where("cid <= 4"), every.where("cid >= 3")]).select("merge_key", "cid", "score")


def cross_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cross_check(derived(spark, sf_dir, "candidates", True), derived(spark, sf_dir, "grounded"))


def update_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest candidate that replaces, amends or repeals each cited number. Texts that may name one are compacted, once and not for each number."""
    cited = [("86/2024/NĐ-CP", "2024-07-01"), ("123/2020/NĐ-CP", "2020-10-19"), ("90/2026/NĐ-CP", "2026-04-01")]
    targets = spark.createDataFrame(cited, "target STRING, target_issued STRING")
    targets = targets.select("target", "target_issued", R.compacted(F.col("target")).alias("n"), T.number_key(F.col("target")).alias("key"))
    rows = derived(spark, sf_dir, "candidates", True).where("issued_date IS NOT NULL").withColumn("text", F.concat_ws(" ", "title", "snippet")).where(R.may_name(F.col("text"), [n for n, _ in cited]))
    rows = rows.select("cid", "score", "issued_date", T.number_key(F.coalesce("document_number", F.lit(""))).alias("own"), T.once(R.compacted(F.col("text"))).alias("t"))
    met = rows.crossJoin(F.broadcast(targets)).where((F.col("issued_date") > F.col("target_issued")) & (F.col("own") != F.col("key")))
    newer = met.withColumn("kind", R.relation_within(F.col("n"), F.col("t"))).where(F.col("kind").isNotNull())
    return newer.groupBy("target").agg(F.max_by(F.struct("cid", "kind"), F.struct("issued_date", "score", (-F.col("cid")).alias("first"))).alias("best")).select("target", "best.cid", "best.kind")


QUERIES = {f.__name__: f for f in (text_fold, text_tokens, document_keys, url_canonical, html_text, html_links, query_hints, query_mentions, query_references, question_plan, source_relevance, lexical_relevance, search_documents, law_admission, answer_grounding, merged_candidates, cross_checked, update_relations)}

_Q = D.quote


def _first(cases: list[tuple[str, str]], x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_Q(p)}) THEN {_Q(label)}" for p, label in cases) + " END"


def _found(x: str, p: str, g: int) -> str:
    return f"nullif(regexp_extract({x}, {_Q(p)}, {g}), '')"


def _types() -> str:
    return "CASE word " + " ".join(f"WHEN {_Q(w)} THEN {_Q(t)}" for w, t in R.TYPE_OF_WORD.items()) + " END"


_HIT = "CASE " + " ".join(f"WHEN regexp_matches(n, {_Q(p)}) THEN struct_pack(number := regexp_extract(n, {_Q(p)}, 1), year := {_found('n', p, 2)})" for p in R.NUMBERS) + " END"
_RULES = "(SELECT * FROM (VALUES " + ", ".join(f"({_Q(k)}, {n}, {_Q(label)}, {_Q(p)})" for k, n, label, p in R.RULES) + ") r(kind, ordinal, label, pattern))"
_SOURCE_RULES = "(SELECT * FROM (VALUES " + ", ".join(f"({_Q(k)}, {n}, {_Q(label)}, {_Q(p)})" for k, n, label, p in R.SOURCE_RULES) + ") r(kind, ordinal, label, pattern))"
_PLANS = f"""
base AS (SELECT qid, {D.normalise_plain('query')} AS normalised FROM {derived_values('queries')}),
hits AS (SELECT qid, kind, label, row_number() OVER (PARTITION BY qid, kind ORDER BY ordinal) AS nth FROM base JOIN {_RULES} r ON regexp_matches(normalised, pattern)),
plans AS (
  SELECT b.*, regexp_matches(normalised, {_Q(R.ASKS)}) AS asks, regexp_matches(normalised, {_Q(R.HAS_REFERENCE)}) AS cites,
    {', '.join(f"(SELECT coalesce(list(label ORDER BY nth), []) FROM hits h WHERE h.qid = b.qid AND kind = '{k}' AND nth <= {cap}) AS {k}s" for k, cap in R.CAPS.items())}
  FROM base b
)"""
_BODY = f"(SELECT cid, concat_ws(' ', document_number, title, snippet) AS body FROM {derived_values('candidates')})"
_ASKED = "(SELECT * FROM (VALUES " + ", ".join(f"({n}, {_Q(q)})" for n, q in ASKED) + ") a(qid, query))"


def _lexical(asked: str, held: str) -> str:
    def has(x: str, p: str) -> str:
        return f"regexp_matches({x}, {_Q(p)})"

    return f"""
WITH asked AS (SELECT qid, {D.normalise_query('query')} AS q, {D.significant_tokens('query')} AS qt FROM {asked}),
held AS (SELECT cid, {D.normalise_query('body')} AS c, {D.significant_tokens('body')} AS ct FROM {held}),
pairs AS (SELECT *, len(list_intersect(qt, ct)) AS matched FROM held, asked),
scored AS (
  SELECT qid, cid, round(greatest(0.0::DOUBLE, least(3.5::DOUBLE, matched::DOUBLE / len(qt)
    + CASE WHEN length(q) > 3 AND contains(c, q) THEN 0.25::DOUBLE ELSE 0 END + least(0.12::DOUBLE, matched * 0.02::DOUBLE)
    + (CASE WHEN {has('q', R.HOUSEHOLD)} THEN CASE WHEN {has('c', R.HOUSEHOLD)} THEN 0.9::DOUBLE ELSE -0.25::DOUBLE END ELSE 0::DOUBLE END
    + CASE WHEN {has('q', R.ASKS_AMOUNT)} THEN CASE WHEN {has('c', R.POLICY)} THEN 1.2::DOUBLE ELSE 0::DOUBLE END - CASE WHEN {has('c', R.PROCEDURE)} THEN 0.45::DOUBLE ELSE 0::DOUBLE END ELSE 0::DOUBLE END
    + CASE WHEN {has('q', R.ASKS_PROCEDURE)} AND {has('c', R.PROCEDURE)} THEN 1.15::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN {has('q', R.INVOICE)} AND {has('c', R.INVOICE)} THEN 1.05::DOUBLE ELSE 0::DOUBLE END))), 6) AS relevance
  FROM pairs WHERE matched > 0)"""


def _url(x: str) -> str:
    host = f"regexp_replace(lower(regexp_extract({x}, '^https://([^/?#]+)', 1, 'i')), '^www\\.', '')"
    path = f"regexp_extract({x}, '^https://[^/?#]+([^?#]*)', 1, 'i')"
    path = f"CASE WHEN length({path}) <= 1 OR regexp_replace({path}, '/+$', '') = '' THEN '/' ELSE regexp_replace({path}, '/+$', '') END"
    kept = f"list_filter(string_split(regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(regexp_replace(p, '=.*$', ''), {_Q(T.TRACKING[4:])}, 'i'))"
    order = f"list_transform(list_sort(list_transform({kept}, lambda p, n: {{'name': regexp_replace(p, '=.*$', ''), 'nth': n, 'whole': p}})), lambda s: s.whole)"
    return f"CASE WHEN {host} = '' THEN '' ELSE 'https://' || {host} || ({path}) || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({order}, '&') ELSE '' END END"


def _claims(x: str) -> str:
    n = D.normalise_plain(f"regexp_replace({x}, '(\\d),(\\d)', '\\1.\\2', 'g')")
    plain = lambda c: f"CASE WHEN regexp_matches({c}, '^\\d{{1,3}}(?:\\.\\d{{3}})+$') THEN replace({c}, '.', '') ELSE {c} END"
    money = f"list_transform(list_zip(regexp_extract_all({n}, {_Q(R.AMOUNT)}, 1), regexp_extract_all({n}, {_Q(R.AMOUNT)}, 2)), lambda z: 'money:' || CAST(CAST(round(TRY_CAST({plain('z[1]')} AS DOUBLE) * CASE z[2] WHEN 'ty' THEN 1e9 WHEN 'trieu' THEN 1e6 WHEN 'nghin' THEN 1e3 ELSE 1 END) AS BIGINT) AS VARCHAR))"
    rates = f"list_transform(regexp_extract_all({n}, {_Q(R.PERCENT)}, 1), lambda v: 'percent:' || CAST(CAST(round(TRY_CAST({plain('v')} AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR))"
    return f"list_sort(list_distinct(list_concat({money}, {rates})))"


def _compact(x: str, keep: str = "a-z0-9%/_.-") -> str:
    return f"regexp_replace({D.normalise_plain(x, keep)}, '\\s+', '', 'g')"


_INTENT_YEARS = "list_transform(regexp_extract_all(n, {p}, 1), lambda y: CAST(y AS INTEGER))"

ORACLE = {
    "text_fold": f"SELECT doc_id, md5({D.fold('text')}) AS folded_md5, md5({D.normalise_query('text')}) AS query_md5, md5({D.tidy('text')}) AS tidy_md5 FROM documents",
    "text_tokens": f"SELECT doc_id, CAST(len({D.retrieval_tokens('text')}) AS BIGINT) AS n_tokens, CAST(len({D.significant_tokens('text')}) AS BIGINT) AS n_distinct, md5(array_to_string(list_sort({D.significant_tokens('text')}), ' ')) AS tokens_md5 FROM documents",
    "document_keys": f"SELECT cid, {D.number_key('coalesce(document_number, title)')} AS number_key, {D.storage_key('coalesce(document_number, title)')} AS storage_key, {D.slug('title')} AS slug, {D.canonical_number(chr(99) + 'oncat_ws(' + _Q(' ') + ', document_number, title)')} AS canonical FROM {derived_values('candidates')}",
    "url_canonical": f"SELECT page_id, {_url('url')} AS canonical, coalesce(lower(regexp_extract(url, '^https://([^/?#:]+)', 1, 'i')) IN ('m.ththth.example.net', 'example.org') OR ends_with(lower(regexp_extract(url, '^https://([^/?#:]+)', 1, 'i')), '.example.org'), false) AS allowed FROM pages",
    "html_text": f"SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, {D.html_to_text('html')} AS t FROM pages)",
    "html_links": r"""
SELECT page_id, count(*) AS n_links, arg_min(link, CASE WHEN regexp_matches(link, '\.docx(?:$|\?)', 'i') THEN 0 WHEN regexp_matches(link, '\.doc(?:$|\?)', 'i') THEN 1 WHEN regexp_matches(link, '\.pdf(?:$|\?)', 'i') THEN 2 ELSE 3 END * 1000000 + pos) AS best
FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?:href|src)=["'']([^"'']+)["'']', 1, 'i') AS l FROM pages)) GROUP BY page_id""",
    "query_hints": f"""
WITH a AS (SELECT qid, {D.normalise_query(D.squeeze(f"regexp_replace(coalesce(query, ''), '[{chr(92)}x00-{chr(92)}x1f{chr(92)}x7f]', ' ', 'g')"))} AS n FROM {derived_values('queries')}),
b AS (SELECT *, {_first(R.TYPES, 'n')} AS type, {_HIT} AS hit FROM a),
c AS (SELECT *, CASE WHEN type IS NOT NULL THEN {_found('n', R.TRAILING, 1)} END AS t FROM b),
d AS (SELECT *, CASE WHEN NOT regexp_matches(t, '^(?:19|20)\\d{{2}}$') THEN t END AS trail FROM c),
e AS (SELECT *, coalesce(CASE WHEN NOT regexp_matches(hit.number, '^(?:19|20)\\d{{2}}$') THEN hit.number END, trail) AS number, len(list_filter(string_split(n, ' '), lambda w: w <> '')) AS words, regexp_matches(n, {_Q(R.QUESTION)}) AS asks FROM d)
SELECT qid, n AS normalised, type, number, coalesce(hit.year, CASE WHEN trail IS NOT NULL THEN {_found('n', R.TRAILING, 2)} END, CASE WHEN number IS NOT NULL THEN {_found('n', chr(92) + 'bnam' + chr(92) + 's+(20' + chr(92) + 'd{2})' + chr(92) + 'b', 1)} END) AS year,
  asks OR (NOT (type IS NOT NULL AND (number IS NOT NULL OR (NOT asks AND words <= 18))) AND words >= 4) AS asks_question, regexp_matches(n, {_Q(R.INJECTION)}) AS injection FROM e""",
    "query_mentions": f"""
WITH a AS (SELECT qid, {D.normalise_query('query')} AS n FROM {derived_values('queries')}),
b AS (SELECT qid, unnest(regexp_extract_all(n, {_Q(R.MENTION)}, 1)) AS word, unnest(regexp_extract_all(n, {_Q(R.MENTION)}, 2)) AS number, unnest(regexp_extract_all(n, {_Q(R.MENTION)}, 3)) AS year, generate_subscripts(regexp_extract_all(n, {_Q(R.MENTION)}, 1), 1) - 1 AS pos FROM a)
SELECT qid, {_types()} AS type, number, nullif(year, '') AS year, CAST(min(pos) AS INTEGER) AS "at" FROM b GROUP BY ALL""",
    "query_references": f"""
WITH a AS (SELECT qid, {D.normalise_plain('query', 'a-z0-9/_.-')} AS n FROM {derived_values('queries')}),
b AS (SELECT qid, contains(n, 'bo tai chinh') AS finance, {', '.join(f"unnest(regexp_extract_all(n, {_Q(R.REFERENCE)}, {g})) AS {c}" for g, c in ((1, 'word'), (2, 'number'), (3, 'year'), (4, 'suffix')))}, generate_subscripts(regexp_extract_all(n, {_Q(R.REFERENCE)}, 1), 1) - 1 AS pos FROM a),
c AS (SELECT *, {_types()} AS type, regexp_replace(suffix, '^[-/]+', '') AS raw FROM b),
d AS (SELECT *, CASE WHEN type = 'Thông tư' AND (raw IN ('btc', 'tt-btc') OR finance) THEN 'TT-BTC' WHEN type = 'Nghị định' THEN 'NĐ-CP' WHEN raw <> '' THEN upper(raw) END AS s FROM c)
SELECT qid, type, number, year, arg_min(s, pos) AS suffix, CAST(min(pos) AS INTEGER) AS "at" FROM d GROUP BY ALL""",
    "question_plan": f"""
WITH {_PLANS}
SELECT qid, asks, cites, array_to_string(areas, '; ') AS areas, array_to_string(subjects, '; ') AS subjects, array_to_string(intents, '; ') AS intents,
  CASE WHEN NOT asks OR cites THEN NULL WHEN list_contains(intents, {_Q(R.INTENTS[0][0])}) AND len(areas) = 0 AND len(subjects) = 0 THEN 'rate'
    WHEN list_contains(intents, {_Q(R.INTENTS[3][0])}) AND len(areas) = 0 AND NOT list_contains(intents, {_Q(R.INTENTS[2][0])}) THEN 'deadline'
    WHEN len(list_filter(string_split(normalised, ' '), lambda w: w <> '')) <= 5 AND len(areas) = 0 AND len(subjects) = 0 AND len(intents) = 0 THEN 'general' END AS clarify
FROM plans""",
    "source_relevance": f"""
WITH a AS (SELECT qid, {D.normalise_plain('query')} AS n FROM {values('queries')}), b AS (SELECT cid, {D.normalise_plain('body')} AS body FROM {_BODY}),
ql AS (SELECT qid, kind, list(label) AS labels FROM a JOIN {_RULES} r ON regexp_matches(n, pattern) GROUP BY ALL), cl AS (SELECT cid, kind, list(label) AS labels FROM b JOIN {_SOURCE_RULES} r ON regexp_matches(body, pattern) GROUP BY ALL),
q AS (SELECT qid, n, regexp_matches(n, {_Q(R.ASKS)}) AND NOT regexp_matches(n, {_Q(R.HAS_REFERENCE)}) AS asks, {', '.join(f"coalesce((SELECT labels FROM ql WHERE ql.qid = a.qid AND kind = '{k}'), []) AS {k}s" for k in R.CAPS)} FROM a),
p AS (SELECT q.*, b.cid, b.body, {', '.join(f"coalesce((SELECT labels FROM cl WHERE cl.cid = b.cid AND kind = '{k}'), []) AS c_{k}s" for k in R.CAPS)}, regexp_matches(body, {_Q(R.ADMINISTRATION)}) AS bridge,
  CASE {' '.join(f'WHEN list_contains(intents, {_Q(x)}) THEN {_Q(x)}' for x in R.PRIMARY)} END AS main,
  list_distinct(list_filter(regexp_split_to_array(n, '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({', '.join(map(_Q, R.RELEVANCE_STOP))}) AND NOT regexp_matches(t, '^20\\d{{2}}$'))) AS tokens FROM q, b),
m AS (SELECT *, {', '.join(f"len(list_intersect({k}s, c_{k}s)) AS n_{k}" for k in R.CAPS)} FROM p)
SELECT qid, cid, round(CASE WHEN NOT asks THEN 1.0::DOUBLE WHEN NOT regexp_matches(body, {_Q(R.TAX_WORDS)}) AND n_area = 0 AND NOT bridge THEN -5.0::DOUBLE
  WHEN list_contains(subjects, {_Q(R.SUBJECTS[1][0])}) AND regexp_matches(body, {_Q(R.HOUSEHOLD)}) AND NOT regexp_matches(body, {_Q(R.BUSINESS)}) THEN -4.5::DOUBLE
  WHEN main IS NOT NULL AND NOT list_contains(c_intents, main) THEN -3.5::DOUBLE WHEN len(areas) > 0 AND n_area = 0 AND n_intent = 0 AND NOT bridge THEN -4.0::DOUBLE
  ELSE n_area * 3 + n_intent * 1.6::DOUBLE + n_subject * 0.7::DOUBLE + CASE WHEN bridge THEN 1.4::DOUBLE ELSE 0::DOUBLE END + least(2.0::DOUBLE, len(list_intersect(tokens, regexp_split_to_array(body, '[^a-z0-9]+'))) * 0.22::DOUBLE) END, 6) AS relevance FROM m""",
    "lexical_relevance": _lexical(values("queries"), _BODY) + " SELECT qid, cid, relevance FROM scored",
    "search_documents": _lexical(_ASKED, "(SELECT doc_id AS cid, text AS body FROM documents)") + " SELECT qid, cid AS doc_id, relevance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, cid) AS rank FROM scored) WHERE rank <= 10",
    "law_admission": f"""
WITH a AS (SELECT qid, {D.normalise_query('query')} AS n FROM {values('queries')}),
b AS (SELECT qid, n, {_INTENT_YEARS.format(p=_Q(R.SCOPED_YEAR))} AS scoped, {_INTENT_YEARS.format(p=_Q(chr(92) + 'b(20' + chr(92) + 'd{2})' + chr(92) + 'b'))} AS years FROM a),
c AS (SELECT qid, CASE WHEN regexp_matches(n, {_Q(R.RELATION)}) THEN 'relationship' WHEN regexp_matches(n, {_Q(R.PAST)}) THEN 'historical'
  WHEN len(list_filter(scoped, lambda y: y < 2026)) > 0 THEN 'historical' WHEN len(list_filter(scoped, lambda y: y > 2026)) > 0 THEN 'future'
  WHEN regexp_matches(n, {_Q(R.FUTURE)}) OR len(list_filter(years, lambda y: y > 2026)) > 0 THEN 'future' ELSE 'current' END AS intent FROM b)
SELECT qid, doc, intent, CASE WHEN status IN ('upcoming', 'expired', 'repealed', 'unknown') THEN status ELSE 'eligible' END AS reason,
  CASE WHEN intent IN ('historical', 'relationship') THEN true WHEN intent = 'future' THEN status IN ('effective', 'partially_effective', 'upcoming') ELSE status IN ('effective', 'partially_effective') END AS allowed
FROM {derived_values('statuses')}, c""",
    "answer_grounding": f"""
SELECT aid, array_to_string(list_sort(list_filter({_claims('answer')}, lambda x: NOT list_contains(e, x))), ' ') AS unsupported,
  len(w) > 0 AND len(list_filter(w, lambda n: length(n) >= 3 AND contains({_compact('answer')}, n))) = 0 AS missing_reference
FROM (SELECT *, {_claims('evidence')} AS e, list_filter(list_transform(string_split(numbers, ';'), lambda x: {_compact('x')}), lambda n: n <> '') AS w FROM {derived_values('answers')})""",
    "merged_candidates": f"""
SELECT merge_key, cid, score FROM (SELECT *, row_number() OVER (PARTITION BY merge_key ORDER BY score DESC, list, cid) AS nth FROM (
  SELECT *, coalesce(nullif({D.number_key('document_number')}, ''), lower(url)) AS merge_key FROM (SELECT *, 0 AS list FROM {derived_values('candidates', True)} WHERE cid <= 4 UNION ALL SELECT *, 1 FROM {derived_values('candidates', True)} WHERE cid >= 3))) WHERE nth = 1""",
    "cross_checked": f"""
WITH d AS (SELECT cid, score, nullif({_url('url')}, '') AS u, nullif({D.canonical_number(chr(99) + 'oncat_ws(' + _Q(' ') + ', document_number, title, url)')}, '') AS n FROM {derived_values('candidates', True)}),
g AS (SELECT gid, nullif({_url('url')}, '') AS gu, nullif({D.canonical_number(chr(99) + 'oncat_ws(' + _Q(' ') + ', document_number, title, url)')}, '') AS gn FROM {derived_values('grounded')}),
m AS (SELECT g.*, (SELECT min(cid) FROM d WHERE u = gu) AS uc, (SELECT arg_min(n, cid) FROM d WHERE u = gu) AS un, (SELECT min(cid) FROM d WHERE n = gn) AS nc FROM g),
o AS (SELECT *, CASE WHEN uc IS NOT NULL AND un <> gn THEN 'conflict' WHEN uc IS NOT NULL OR nc IS NOT NULL THEN 'match' WHEN gu IS NULL THEN 'ignored' ELSE 'new' END AS outcome FROM m),
c AS (SELECT *, CASE outcome WHEN 'match' THEN coalesce(uc, nc) WHEN 'conflict' THEN uc END AS cid FROM o)
SELECT gid, outcome, c.cid, round(d.score + CASE WHEN outcome = 'match' THEN (SELECT count(*) FROM c x WHERE x.cid = c.cid AND x.outcome = 'match') * 1.15::DOUBLE ELSE 0 END, 6) AS score FROM c LEFT JOIN d USING (cid)""",
    "update_relations": f"""
WITH t AS (SELECT * FROM (VALUES ('86/2024/NĐ-CP', '2024-07-01'), ('123/2020/NĐ-CP', '2020-10-19'), ('90/2026/NĐ-CP', '2026-04-01')) t(target, target_issued)),
a AS (SELECT *, {_compact('concat_ws(' + _Q(' ') + ', title, snippet)', 'a-z0-9/_.-')} AS body, {_compact('target', 'a-z0-9/_.-')} AS n FROM {derived_values('candidates', True)}, t),
b AS (SELECT *, CASE WHEN instr(body, n) > 0 THEN substr(body, greatest(1, instr(body, n) - 260), length(n) + 260 + least(260, instr(body, n) - 1)) END AS w FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(w, 'thaythe') THEN 'replacement' WHEN regexp_matches(w, 'suadoi|bosung|dinhchinh') THEN 'amendment' WHEN regexp_matches(w, 'baibo|hethieuluc') THEN 'repeal' END AS kind FROM b)
SELECT target, cid, kind FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY issued_date DESC, score DESC, cid) AS nth FROM c
  WHERE kind IS NOT NULL AND issued_date > target_issued AND {D.number_key("coalesce(document_number, '')")} <> {D.number_key('target')}) WHERE nth = 1""",
}
