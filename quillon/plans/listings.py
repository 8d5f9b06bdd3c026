"""Queries over result pages, listings, article pages and transcripts, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import listings as L
from quillon.plans.fixtures import derived, derived_values
from quillon.plans.publishing import _chain, _re
from quillon.plans.retrieval import table

_Q = D.quote
BASE = "https://vanban.chinhphu.vn/he-thong/van-ban-moi?page=1"
CURATED = ["108/2025/QH15", "89/2026/TT-BTC", "70/2025/NĐ-CP"]


def decoded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with their character references decoded."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(L.decode_references(F.coalesce("html", F.lit("")))).alias("html_md5"))


def reference_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "references").select("rid", L.decode_references(F.col("text")).alias("decoded"))


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.listed_documents(derived(spark, sf_dir, "listing_pages"), "page", "html", BASE)


def found_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.found_documents(derived(spark, sf_dir, "listing_pages"), "page", "html", "hint", BASE)


def gazette_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "gazette_rows").select("gid", L.gazette_score(F.col("number"), F.col("hint"), F.col("base")).alias("score"))


def best_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the text by the best method, then the longest, then the first."""
    order = F.struct(L.method_rank(F.col("method")), -F.length("text"), F.col("did"))
    rows = derived(spark, sf_dir, "method_texts").select("number", "did", T.once(order).alias("order"))  # else texts are sorted before they are aggregated
    return rows.groupBy("number").agg(F.min_by("did", "order").alias("did"))


def legal_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the legal text normaliser."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.normalise_legal(F.col("text"))).alias("text_md5"))


def legal_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "markdown_texts").select("mid", L.normalise_legal(F.col("text")).alias("text"))


def accepted_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, "transcript_runs").withColumn("raw", F.concat("head", F.expr("repeat('nội dung ', filler)")))
    return L.accept_transcripts(rows.withColumn("text", F.col("raw")), "tid")


def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.article_bodies(derived(spark, sf_dir, "article_pages"), "page", "html", "number")


def curated_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "queries").select("qid", L.curated_number(F.col("query"), CURATED).alias("number"))


QUERIES = {f.__name__: f for f in (decoded_references, reference_cases, listed_documents, found_documents, gazette_scores, best_by_method, legal_normalised, legal_markdown, accepted_transcripts, article_bodies, curated_matches)}


def _decoded(x: str) -> str:
    p = L._REFERENCE
    inner = p[2:-2]
    point = "CASE WHEN regexp_matches(n, '^#[xX]') THEN CAST('0x' || substr(n, 3) AS BIGINT) WHEN n LIKE '#%' THEN CAST(substr(n, 2) AS BIGINT) END"
    named = " ".join(f"WHEN {_Q(k)} THEN {_Q(v)}" for k, v in L._NAMED.items())
    one = f"CASE WHEN lower(n) IN ({', '.join(map(_Q, L._NAMED))}) THEN CASE lower(n) {named} END WHEN coalesce(({point}) BETWEEN 1 AND 1114111 AND NOT ({point}) BETWEEN 55296 AND 57343, false) THEN chr(CAST({point} AS INTEGER)) ELSE '&' || n || ';' END"
    return f"CASE WHEN {x} IS NOT NULL THEN array_to_string(list_transform(list_zip(regexp_split_to_array({x}, {_Q('&(?:' + inner + ');')}), list_transform(regexp_extract_all({x}, {_Q(p)}, 1), lambda n: {one})), lambda z: z[1] || coalesce(z[2], '')), '') END"


_JS = "[\\s\x0b\xa0\ufeff]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_Q(f'^{_JS}+|{_JS}+$')}, '', 'g')"


def _bare(x: str) -> str:
    stripped = _chain(x, [(r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), ("<[^>]+>", " ")])
    return _strip(f"regexp_replace({_decoded(stripped)}, {_Q(_JS + '+')}, ' ', 'g')")


def _links(before: int, after: int) -> str:
    """Links of the listing pages; bases of the fixture's links are roots, queries or whole URLs."""
    p = _Q(L.DOCUMENT_LINK)
    url = _decoded(f"regexp_extract(hit, {p}, 1)")
    return f"""
WITH a AS (SELECT page, hint, html, regexp_extract_all(html, {p}, 0) AS h, regexp_split_to_array(html, {p}) AS s FROM {derived_values('listing_pages')}),
b AS (SELECT page, hint, html, unnest(h) AS hit, unnest(s[1:len(h)]) AS gap, generate_subscripts(h, 1) - 1 AS pos FROM a),
c AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY page ORDER BY pos) AS BIGINT) - length(hit) AS head FROM b),
d AS (SELECT page, hint, pos, {url} AS link, {_bare(f'regexp_extract(hit, {p}, 2)')} AS anchor, {_bare(f"substr(html, greatest(0, head - {before}) + 1, head + length(hit) + {after} - greatest(0, head - {before}))")} AS around FROM c),
e AS (SELECT *, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN link LIKE '//%' THEN 'https:' || link WHEN link LIKE '/%' THEN 'https://vanban.chinhphu.vn' || link WHEN link LIKE '?%' THEN 'https://vanban.chinhphu.vn/he-thong/van-ban-moi' || link ELSE 'https://vanban.chinhphu.vn/he-thong/' || link END AS url FROM d),
f AS (SELECT * FROM e WHERE ends_with(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1, 'i')), 'chinhphu.vn'))"""


def _suffix(cases: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(number, {_Q('(?i)' + p + '$')}) THEN {_Q(label)}" for p, label in cases) + f" ELSE {_Q(other)} END"


_MARK = L.PAGE_MARK.replace("(?imu)", "(?im)")
_TEXT_RULES = [(p.replace(r"\z", "$") if "(\\s|\\z)" in p else p, by.replace("$2", "\\2").replace("$3", "\\3")) for p, by in L.LEGAL_TEXT_RULES]
_CUT = _Q(L.ARTICLE_TAILS.replace("(?iu)", "(?i)"))
_SCORE = " + ".join(f"len(regexp_extract_all(text, {_Q(_re(p))})) * {w}" for p, w in L.COMPLETENESS)


def _normalised(x: str) -> str:
    lines = f"list_transform(string_split({_chain(x, _TEXT_RULES)}, chr(10)), lambda y: {_strip(_chain('y', L.LEGAL_LINE_RULES))})"
    return _strip(f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


_REST = f"trim(regexp_split_to_array(regexp_replace(around, '^.*?' || number || '\\s*', '', 'is'), '(?i){L.BEHIND_TITLE[5:]}')[1])"


def _day(x: str, label: str) -> str:
    """The first day behind a label, as ISO text; null if there is none."""
    p = _Q(f"(?is){label}{L.DAY}" if label else L.DAY)
    return f"CASE WHEN regexp_matches({x}, {p}) THEN CAST(TRY_CAST(regexp_extract({x}, {p}, 3) || '-' || lpad(regexp_extract({x}, {p}, 2), 2, '0') || '-' || lpad(regexp_extract({x}, {p}, 1), 2, '0') AS DATE) AS VARCHAR) END"


ORACLE = {
    "decoded_references": f"SELECT page_id, md5({_decoded('t')}) AS html_md5 FROM (SELECT page_id, coalesce(html, '') AS t FROM pages)",
    "reference_cases": f"SELECT rid, {_decoded('text')} AS decoded FROM {derived_values('references')}",
    "listed_documents": f"""{_links(500, 1500)},
g AS (SELECT *, anchor || ' ' || around AS whole FROM f), h AS (SELECT *, regexp_replace(regexp_extract(whole, {_Q(_re(L.LISTED_NUMBER).replace('(?iu)', '(?i)'))}, 0), '\\s+', '', 'g') AS number FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY page, lower(number) ORDER BY pos) AS nth FROM h WHERE number <> '' AND regexp_matches(whole, {_Q(_re(L.LISTED_TOPIC))}))
SELECT * FROM (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY pos) AS INTEGER) AS rank, number, url, anchor,
  CASE WHEN anchor <> '' AND NOT contains(anchor, number) THEN anchor WHEN {_REST} <> '' THEN {_REST} ELSE 'Văn bản số ' || number END AS title,
  coalesce({_day('whole', L.ISSUED)}, {_day('whole', '')}) AS issued, {_day('whole', L.EFFECTIVE)} AS effective, {_suffix(L.TYPE_BY_SUFFIX, 'Văn bản pháp luật')} AS type, {_suffix(L.ISSUER_BY_SUFFIX, '')} AS issuer FROM i WHERE nth = 1) WHERE rank <= 20""",
    "found_documents": f"""{_links(450, 1100)},
g AS (SELECT page, pos, url, anchor, left(around, 1400) AS snippet, {D.number_key('hint')} AS k FROM f WHERE anchor <> ''),
h AS (SELECT *, regexp_replace(regexp_extract(anchor || ' ' || snippet, {_Q('(?i)' + T.FULL_NUMBER[5:])}, 0), '\\s+', '', 'g') AS number, row_number() OVER (PARTITION BY page, url ORDER BY pos) AS nth FROM g),
i AS (SELECT *, CASE WHEN number <> '' AND {D.number_key('number')} = k THEN 4.8::DOUBLE WHEN length(k) >= 4 AND (contains({D.number_key('anchor')}, k) OR contains({D.number_key('snippet')}, k)) THEN 1.8::DOUBLE ELSE 0.65::DOUBLE END AS score FROM h WHERE nth = 1)
SELECT * FROM (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, pos) AS INTEGER) AS rank, url, anchor, number, score FROM i) WHERE rank <= 18""",
    "gazette_scores": f"SELECT gid, CASE WHEN length(h) >= 4 AND n = h THEN 5.2::DOUBLE WHEN length(h) >= 4 AND contains(n, h) THEN 3.4::DOUBLE ELSE 1.4::DOUBLE + greatest(0, least(1, coalesce(base, 0))) END AS score FROM (SELECT gid, base, {D.number_key('number')} AS n, {D.number_key('hint')} AS h FROM {derived_values('gazette_rows')})",
    "best_by_method": f"SELECT number, did FROM (SELECT number, did, row_number() OVER (PARTITION BY number ORDER BY coalesce(list_position({L.EXTRACTION_METHODS}, method), 99), length(text) DESC, did) AS nth FROM {derived_values('method_texts')}) WHERE nth = 1",
    "legal_normalised": f"SELECT doc_id, md5({_normalised('text')}) AS text_md5 FROM documents",
    "legal_markdown": f"SELECT mid, {_normalised('text')} AS text FROM {derived_values('markdown_texts')}",
    "accepted_transcripts": f"""
WITH a AS (SELECT *, head || repeat('nội dung ', filler) AS t FROM {derived_values('transcript_runs')}),
b AS (SELECT *, len(list_distinct(list_filter(regexp_extract_all(t, {_Q(_MARK)}, 1), lambda p: CAST(p AS INTEGER) >= 1))) AS m FROM a),
c AS (SELECT tid, m, concat_ws(',', CASE WHEN regexp_matches(finish, {_Q(L.BROKEN_END)}) THEN 'broken_end' END, CASE WHEN length(t) < greatest(800, least(greatest(1, total_pages), 80) * 260) THEN 'short' END, CASE WHEN score < 0.68 THEN 'score' END,
  CASE WHEN total_pages >= 4 AND m > 0 AND m < ceil(total_pages * 0.7) THEN 'page_marks' END, CASE WHEN len(regexp_extract_all(t, {_Q(_re(L.UNREAD))})) > greatest(3, ceil(total_pages * 0.35)) THEN 'unread' END,
  CASE WHEN total_pages >= 2 AND len(regexp_extract_all(t, {_Q(_re(L.PROVISION_MARK))})) < 2 THEN 'structure' END) AS w FROM b)
SELECT tid, w AS warnings, w = '' AS accepted, CAST(m AS INTEGER) AS page_marks FROM c""",
    "curated_matches": f"SELECT qid, CASE {' '.join(f'WHEN contains(k, {D.number_key(_Q(n))}) THEN {_Q(n)}' for n in CURATED)} END AS number FROM (SELECT qid, {D.number_key('query')} AS k FROM {derived_values('queries')})",
}
