"""The whole search over all documents, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import index as I
from quillon.operators import publishing as P
from quillon.operators import retrieval as R
from quillon.operators import search as S
from quillon.plans.retrieval import table
from quillon.sources.shared import shared_folder

#: The stated query set: look-ups with and without a year, and questions in the words of the documents.
ASKED = [
    (1, "Thông tư 15"), (2, "Thông tư 15/2024"), (3, "nghị định số 18 năm 2020"), (4, "the and attion to thanedble bao nhiêu"),
    (5, "eauouon enpaeux leaux thì nộp thuế thế nào"), (6, "văn bản sửa đổi heitü entepf stber, thời hạn bao giờ"), (7, "Quyết định 999"),
    (8, "worthless licence apache"), (9, "Nghị quyết 20/2023 quy định thế nào, khai thuế"), (10, "osbo ciónll asción"), (11, ""),
]
#: Queries whose sources are said to contradict each other.
CONFLICTS = [1, 7, 8]
THIS_YEAR = 2026
#: Kinds of documents and the suffixes of their numbers; documents carry one of them by their id.
KINDS = [("Nghị định", "NĐ-CP"), ("Thông tư", "TT-BTC"), ("Nghị quyết", "NQ-CP"), ("Quyết định", "QĐ-TTg")]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources of a retrieval: number, type, dates and issuer follow from id and source, the body is the whole text."""
    key = F.col("doc_id")
    of = lambda part: F.get(F.array(*[F.lit(k[part]) for k in KINDS]), (key % 4).cast("int"))
    year = (2018 + key % 9).cast("string")
    number = F.concat((10 + key % 40).cast("string"), F.lit("/"), year, F.lit("/"), of(1))
    more = F.when(key % 5 == 0, " sửa đổi, bổ sung").when(key % 7 == 0, " quy định chi tiết").otherwise("")
    return table(spark, sf_dir, "documents").select(
        key.alias("cid"), number.alias("number"), of(0).alias("type"), F.concat(of(0), F.lit(" "), number, more).alias("title"), F.col("source").alias("issuer"),
        F.concat_ws("-", year, F.lpad((1 + key % 12).cast("string"), 2, "0"), F.lpad((1 + key % 28).cast("string"), 2, "0")).alias("issued"),
        F.concat(F.lit("https://example.org/"), key.cast("string")).alias("url"), F.col("text").alias("body"),
    )


def answered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response for each query, over all documents."""
    asked = spark.createDataFrame(ASKED, "qid INT, query STRING")
    held = sources(spark, sf_dir)
    folder = shared_folder(spark, "index")
    index = I.build(held.select("cid", F.concat_ws(" ", "title", "body").alias("body")), folder)
    return S.search(asked, held, index, THIS_YEAR, spark.createDataFrame([(n,) for n in CONFLICTS], "qid INT"), folder=f"{folder}/found")


QUERIES = {"answered_queries": answered_queries}

_Q = D.quote


def _has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {_Q(p)})"


def _lexical(q: str, qt: str, c: str, ct: str) -> str:
    """Relevance of a normalised text with its tokens for a normalised query with its own; 0 without a shared token."""
    m = f"len(list_intersect({qt}, {ct}))"
    return f"""CASE WHEN {m} = 0 THEN 0::DOUBLE ELSE greatest(0.0::DOUBLE, least(3.5::DOUBLE, {m}::DOUBLE / len({qt})
      + CASE WHEN length({q}) > 3 AND contains({c}, {q}) THEN 0.25::DOUBLE ELSE 0 END + least(0.12::DOUBLE, {m} * 0.02::DOUBLE)
      + (CASE WHEN {_has(q, R.HOUSEHOLD)} THEN CASE WHEN {_has(c, R.HOUSEHOLD)} THEN 0.9::DOUBLE ELSE -0.25::DOUBLE END ELSE 0::DOUBLE END
      + CASE WHEN {_has(q, R.ASKS_AMOUNT)} THEN CASE WHEN {_has(c, R.POLICY)} THEN 1.2::DOUBLE ELSE 0::DOUBLE END - CASE WHEN {_has(c, R.PROCEDURE)} THEN 0.45::DOUBLE ELSE 0::DOUBLE END ELSE 0::DOUBLE END
      + CASE WHEN {_has(q, R.ASKS_PROCEDURE)} AND {_has(c, R.PROCEDURE)} THEN 1.15::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN {_has(q, R.INVOICE)} AND {_has(c, R.INVOICE)} THEN 1.05::DOUBLE ELSE 0::DOUBLE END))) END"""


def _tokens(normalised: str) -> str:
    """Distinct tokens of a text that is normalised already."""
    words, same = ", ".join(map(_Q, T.STOP_WORDS)), ", ".join(map(_Q, T.SYNONYMS))
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array({normalised}, '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({words})), lambda t: CASE WHEN t IN ({same}) THEN '{T.SYNONYM}' ELSE t END))"


def _number(text: str, number: str) -> str:
    return f"coalesce(regexp_matches({text}, '(?:^|[^0-9])' || {number} || '(?:/|[^0-9]|$)'), false)"


def _year_score(issued: str) -> str:
    age = f"({THIS_YEAR} - TRY_CAST(left({issued}, 4) AS INTEGER))"
    return f"CASE WHEN {age} >= {P.OLD_YEARS} THEN {P.OLD_MALUS}::DOUBLE " + " ".join(f"WHEN {age} = {n} THEN {x}::DOUBLE" for n, x in P.YEAR_BONUS.items()) + " ELSE 0::DOUBLE END"


def _amendment(text: str) -> str:
    return f"CASE WHEN {_has(D.normalise_query(text), P.AMENDS)} THEN 2.2::DOUBLE WHEN {_has(D.normalise_query(text), P.DETAILS)} THEN 0.35::DOUBLE ELSE 0::DOUBLE END"


def _first(cases: list[tuple[str, str]], x: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(x, p)} THEN {_Q(label)}" for p, label in cases) + " END"


def _found(x: str, p: str, g: int) -> str:
    return f"nullif(regexp_extract({x}, {_Q(p)}, {g}), '')"


_HIT = "CASE " + " ".join(f"WHEN {_has('n', p)} THEN struct_pack(number := regexp_extract(n, {_Q(p)}, 1), year := {_found('n', p, 2)})" for p in R.NUMBERS) + " END"
_KIND = lambda part: "CASE doc_id % 4 " + " ".join(f"WHEN {n} THEN {_Q(k[part])}" for n, k in enumerate(KINDS)) + " END"
_YEARLIKE = r"'^(?:19|20)\d{2}$'"
_STRIPPED = "regexp_replace({}, '^[\\s ﻿]+|[\\s ﻿]+$', '', 'g')"
_SAME = f"regexp_replace({D.normalise_query('coalesce(source_number, title)')}, '\\s+', '', 'g') || ':' || {D.normalise_query(chr(99) + 'oalesce(issuer, ' + _Q('') + ')')}"
_CLEAN = D.squeeze(r"regexp_replace(coalesce(query, ''), '[\x00-\x1f\x7f]', ' ', 'g')")
_EXCERPT = "CASE WHEN length(s) <= 900 THEN s WHEN length(regexp_extract(left(s, 900), '(?s)^(.*[.;])\\s', 1)) > 421 THEN regexp_extract(left(s, 900), '(?s)^(.*[.;])\\s', 1) ELSE rtrim(left(s, 900)) || '…' END"

ORACLE = {
    "answered_queries": f"""
WITH asked AS (SELECT * FROM (VALUES {', '.join(f'({n}, {_Q(q)})' for n, q in ASKED)}) a(qid, query)),
a AS (SELECT qid, {D.normalise_query(_CLEAN)} AS n FROM asked),
b AS (SELECT *, {_first(R.TYPES, 'n')} AS type, {_HIT} AS hit FROM a),
c AS (SELECT *, CASE WHEN type IS NOT NULL THEN {_found('n', R.TRAILING, 1)} END AS t FROM b),
d AS (SELECT *, CASE WHEN NOT regexp_matches(t, {_YEARLIKE}) THEN t END AS trail FROM c),
e AS (SELECT *, coalesce(CASE WHEN NOT regexp_matches(hit.number, {_YEARLIKE}) THEN hit.number END, trail) AS number, len(list_filter(string_split(n, ' '), lambda w: w <> '')) AS words, {_has('n', R.QUESTION)} AS asks FROM d),
hints AS (SELECT qid, n AS q, {_tokens('n')} AS qt, type, number, coalesce(hit.year, CASE WHEN trail IS NOT NULL THEN {_found('n', R.TRAILING, 2)} END, CASE WHEN number IS NOT NULL THEN {_found('n', r'\bnam\s+(20\d{2})\b', 1)} END) AS year,
  asks OR (NOT (type IS NOT NULL AND (number IS NOT NULL OR (NOT asks AND words <= 18))) AND words >= 4) AS asks FROM e),
sources AS (SELECT doc_id AS cid, (10 + doc_id % 40) || '/' || (2018 + doc_id % 9) || '/' || {_KIND(1)} AS source_number, {_KIND(0)} AS source_type, source AS issuer, text AS body, 'https://example.org/' || doc_id AS url,
  (2018 + doc_id % 9) || '-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS issued,
  CASE WHEN doc_id % 5 = 0 THEN ' sửa đổi, bổ sung' WHEN doc_id % 7 = 0 THEN ' quy định chi tiết' ELSE '' END AS more FROM documents),
held AS (SELECT *, source_type || ' ' || source_number || more AS title FROM sources),
texts AS (SELECT cid, {D.normalise_query("concat_ws(' ', title, body)")} AS c FROM held),
tokens AS (SELECT cid, c, {_tokens('c')} AS ct FROM texts),
pairs AS (SELECT qid, cid, {_lexical('q', 'qt', 'c', 'ct')} AS relevance FROM tokens, hints WHERE len(list_intersect(qt, ct)) > 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, cid) AS rank FROM pairs) WHERE rank <= 30),
described AS (SELECT h.*, x.* EXCLUDE (cid), t.cid AS cid, relevance, {D.normalise_query("concat_ws(' ', source_number, source_type, title, url)")} AS described,
  {D.normalise_query("coalesce(nullif(source_number, ''), title, '')")} AS nt, {D.normalise_query("coalesce(nullif(source_type, ''), title, '')")} AS tt, {D.normalise_query('type')} AS wanted
  FROM hits t JOIN hints h USING (qid) JOIN held x ON x.cid = t.cid),
scored AS (SELECT *, (number IS NULL OR {_number('nt', 'number')}) AND (year IS NULL OR contains(nt, year)) AND (type IS NULL OR contains(tt, wanted)) AS exact FROM described),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS place FROM (SELECT *, round(relevance + {_lexical('q', 'qt', 'described', _tokens('described'))}
  + CASE WHEN number IS NOT NULL AND {_number('described', 'number')} THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN contains(described, year) THEN 1.8::DOUBLE ELSE 0 END
  + CASE WHEN contains(described, wanted) THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN source_number <> '' AND exact THEN 2.2::DOUBLE ELSE 0 END
  + CASE WHEN asks THEN {_year_score('issued')} + {_amendment('title')} ELSE 0 END, 6) AS score FROM scored)),
same AS (SELECT *, row_number() OVER (PARTITION BY qid, {_SAME} ORDER BY score DESC, cid) AS nth FROM ranked WHERE number IS NOT NULL AND type IS NOT NULL AND year IS NULL AND NOT asks AND exact),
several AS (SELECT qid, list(cid ORDER BY score DESC, cid)[1:10] AS choices FROM same WHERE nth = 1 GROUP BY qid HAVING count(*) > 1),
readable AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS opened FROM ranked WHERE place <= CASE WHEN asks THEN 12 ELSE 7 END AND length({_STRIPPED.format('body')}) >= 800 AND (exact OR asks)),
fit AS (SELECT *, {D.normalise_query("concat_ws(' ', source_number, title, body)")} AS c FROM readable WHERE opened <= CASE WHEN asks THEN 4 ELSE 1 END),
documents_ AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fit DESC, opened) AS nth FROM (SELECT *, CASE WHEN asks THEN round({_lexical('q', 'qt', 'c', _tokens('c'))} + {_year_score('issued')} + {_amendment('title')}, 6) ELSE 0 END AS fit FROM fit)),
copies AS (SELECT *, row_number() OVER (PARTITION BY qid, nth > 1, {_SAME} ORDER BY nth) AS copy FROM documents_),
per AS (SELECT qid, arg_min(cid, nth) AS document, count(*) AS opened, list(cid ORDER BY nth) FILTER (WHERE nth > 1 AND copy = 1) AS others FROM copies GROUP BY qid),
lines AS (SELECT qid, cid, q, qt, nth, source_number, title, issued, list_filter(string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS l FROM documents_ WHERE asks),
parts AS (SELECT * EXCLUDE (l), unnest(l) AS official, generate_subscripts(l, 1) - 1 AS pos FROM lines),
told AS (SELECT *, 'Đoạn ' || (pos + 1) AS identifier FROM parts WHERE length({_STRIPPED.format('official')}) > 80),
plain AS (SELECT *, {D.normalise_query("concat_ws(' ', source_number, title, identifier, official)")} AS c FROM told),
totals AS (SELECT *, round(round({_lexical('q', 'qt', 'c', _tokens('c'))}, 12) + ({_year_score('issued')} + {_amendment('title')}), 6) AS total FROM plain),
firsts AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY total DESC, pos, nth) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_number, identifier ORDER BY total DESC, pos, nth) AS copy FROM totals) WHERE copy = 1),
excerpts AS (SELECT qid, place, source_number || ' — ' || identifier || chr(10) || {_EXCERPT} AS line FROM (SELECT *, {D.squeeze('official')} AS s FROM firsts WHERE place <= 3)),
said AS (SELECT qid, md5(string_agg(line, chr(10) || chr(10) ORDER BY place)) AS excerpts_md5 FROM excerpts GROUP BY qid),
found AS (SELECT qid, count(*) AS n FROM ranked GROUP BY qid),
out AS (SELECT h.qid, asks, number, document, choices, others, opened, n, excerpts_md5, CASE WHEN choices IS NOT NULL THEN 'ambiguous' WHEN document IS NULL THEN 'none' WHEN asks THEN 'excerpts' WHEN number IS NOT NULL THEN 'numbered' ELSE 'named' END AS response
  FROM hints h LEFT JOIN several USING (qid) LEFT JOIN per USING (qid) LEFT JOIN said USING (qid) LEFT JOIN found USING (qid))
SELECT qid, CASE WHEN asks THEN 'question' ELSE 'document' END AS kind, response, CASE WHEN response <> 'ambiguous' THEN document END AS document, coalesce(n, 0) AS n_found, coalesce(opened, 0) AS n_opened,
  coalesce(array_to_string(coalesce(choices, CASE WHEN asks THEN others[1:5] END), ','), '') AS choices, CASE WHEN response = 'excerpts' THEN excerpts_md5 END AS excerpts_md5,
  CASE WHEN qid IN ({', '.join(map(str, CONFLICTS))}) AND response IN ('ambiguous', 'none') THEN least({S.CONFLICT_CAP}, c) ELSE c END AS confidence
FROM (SELECT *, CASE response {' '.join(f"WHEN '{k}' THEN {x}::DOUBLE" for k, x in S.CONFIDENCE.items())} END AS c FROM out)""",
}
