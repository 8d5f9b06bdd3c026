"""Selection queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import retrieval as R
from quillon.operators import selection as C
from quillon.plans.fixtures import derived, derived_values, frame, values
from quillon.plans.retrieval import ORACLE as KNOWN
from quillon.plans.retrieval import table

_Q = D.quote


def _hints(asked: DataFrame) -> DataFrame:
    return R.search_hints(asked.withColumn("query", T.clean_user_query(F.col("query"))))


def search_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.variants(_hints(derived(spark, sf_dir, "queries")), "query").select("qid", F.array_join("variants", " | ").alias("variants"))


def hint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.hint_matches(_hints(frame(spark, "queries")), derived(spark, sf_dir, "candidates"))


def high_risk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = R.question_plans(derived(spark, sf_dir, "queries"))
    return plans.select("qid", C.high_risk(plans).alias("risky"))


def backward_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that cost less than the customer's order before."""
    return C.backward_jumps(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_totalprice"))


def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that aren't like one before."""
    lines = F.filter(F.transform(F.split(T.tidy(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 12)
    return table(spark, sf_dir, "documents").select("doc_id", C.greedy_distinct(lines, 0.72).alias("kept")).select("doc_id", F.size("kept").alias("n"), F.md5(F.array_join("kept", "|")).alias("kept_md5"))


def recent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(T.tidy(F.col("text")), "\n")).alias("at", "line"))
    return C.recent_repeats(lines, "doc_id", "at", "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("repeat"), 1)).alias("repeats"))


def grounded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose last 40 characters stand in the turn before, and those whose numbers do."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    numbers = F.regexp_extract_all("text", F.lit(r"\b(\d+(?:[.,/]\d+)*)\b"), F.lit(1))
    return rows.select("conv_id", "turn", C.contained(F.col("before"), F.right("text", F.lit(40))).alias("quoted"), F.forall(numbers, lambda n: F.contains(F.col("before"), n)).alias("grounded"))


def most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, the document with most lines, then most sentence ends, then the longest."""
    docs = table(spark, sf_dir, "documents")
    return C.most_complete(docs, "source", F.regexp_count("text", F.lit("\n")), F.regexp_count("text", F.lit(r"[.]")), F.length("text"), "doc_id")


def text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring drafts of a page against each other."""
    rows = derived(spark, sf_dir, "drafts").groupBy("page").agg(F.max(F.when(F.col("pass") == "literal", F.col("score"))).alias("a"), F.max(F.when(F.col("pass") != "literal", F.col("score"))).alias("b"))
    return rows.select("page", C.recommend(F.col("a"), F.col("b")).alias("choice"))


def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 80 users seen last: a top-k, the limit is the feature."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen")).orderBy(F.col("last_seen").desc(), "user_id").limit(80)


QUERIES = {f.__name__: f for f in (search_variants, hint_matches, high_risk_questions, backward_jumps, distinct_lines, recent_repeats, grounded_turns, most_complete, text_choice, newest_first)}

_REST = f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(normalised, {_Q(chr(92) + 'b' + chr(92) + 'd{1,4}' + chr(92) + 's*[/-]' + chr(92) + 's*20' + chr(92) + 'd{2}' + chr(92) + 's*[/-]' + chr(92) + 's*' + R.SUFFIX + chr(92) + 'b')}, ' ', 'g'), {_Q(C.TYPE_WORDS)}, ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('so', 'nam') AND NOT coalesce(w = number, false) AND NOT coalesce(w = year, false))"
_INTENTS = ", ".join(f"CASE WHEN regexp_matches(n, {_Q(p)}) THEN {_Q(label)} END" for label, p in R.INTENTS)
_RISKY = ", ".join(map(_Q, C.HIGH_RISK_INTENTS))
ORACLE = {
    "search_variants": f"""
WITH h AS ({KNOWN['query_hints']}), q AS (SELECT h.*, {D.squeeze('query')} AS clean, array_to_string({_REST}, ' ') AS rest, concat_ws('/', number, CASE WHEN number IS NOT NULL THEN year END) AS id FROM h JOIN {derived_values('queries')} USING (qid)),
v AS (SELECT qid, CASE WHEN asks_question OR type IS NULL THEN [clean] ELSE list_concat([clean], CASE WHEN number IS NOT NULL THEN [concat_ws(' ', type, id), concat_ws(' ', type, 'số', id)] ELSE [] END,
  CASE WHEN number IS NOT NULL AND rest <> '' THEN [concat_ws(' ', type, id, rest), concat_ws(' ', type, rest, id), concat_ws(' ', rest, type, id)] WHEN rest <> '' THEN [concat_ws(' ', type, rest), rest] ELSE [] END) END AS l FROM q),
e AS (SELECT qid, u, min(nth) AS nth FROM (SELECT qid, unnest(l) AS u, generate_subscripts(l, 1) AS nth FROM v) WHERE u <> '' GROUP BY qid, u)
SELECT qid, string_agg(u, ' | ' ORDER BY nth) AS variants FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY nth) AS r FROM e) WHERE r <= 6 GROUP BY qid""",
    "hint_matches": f"""
WITH h AS ({KNOWN['query_hints'].replace(derived_values('queries'), values('queries'))}), c AS (SELECT cid, {D.normalise_plain("concat_ws(' ', document_number, title)", 'a-z0-9/_.-')} AS t FROM {derived_values('candidates')})
SELECT qid, cid FROM h JOIN c ON regexp_matches(t, '(?:^|[^0-9])' || number || '(?:[^0-9]|$)') AND (year IS NULL OR contains(t, year)) WHERE number IS NOT NULL""",
    "high_risk_questions": f"SELECT qid, regexp_matches(n, {_Q(R.ASKS)}) AND NOT regexp_matches(n, {_Q(R.HAS_REFERENCE)}) AND (regexp_matches(n, {_Q(C.HIGH_RISK)}) OR len(list_filter(list_filter([{_INTENTS}], lambda x: x IS NOT NULL)[1:4], lambda x: x IN ({_RISKY}))) > 0) AS risky FROM (SELECT qid, {D.normalise_plain('query')} AS n FROM {derived_values('queries')})",
    "backward_jumps": "SELECT o_custkey, o_orderkey, before, number FROM (SELECT o_custkey, o_orderkey, o_totalprice AS number, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders WHERE o_totalprice IS NOT NULL) WHERE number < before",
    "recent_repeats": f"""
WITH a AS (SELECT doc_id, string_split({D.tidy('text')}, chr(10)) AS l FROM documents), b AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM a), c AS (SELECT doc_id, pos, {D.normalise_plain('line', 'a-z0-9')} AS key FROM b),
d AS (SELECT *, key <> '' AND ({' OR '.join(f'coalesce(lag(key, {n}) OVER w = key, false)' for n in range(1, 5))}) AS r FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE r) AS repeats FROM d GROUP BY doc_id""",
    "grounded_turns": f"""
WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, length(lower({D.squeeze('right(text, 40)')})) >= 12 AND contains(lower({D.squeeze('before')}), lower({D.squeeze('right(text, 40)')})) AS quoted, len(list_filter(regexp_extract_all(text, '\\b(\\d+(?:[.,/]\\d+)*)\\b', 1), lambda n: NOT contains(before, n))) = 0 AS grounded FROM a WHERE before IS NOT NULL""",
    "most_complete": """
WITH a AS (SELECT source, doc_id, (length(text) - length(replace(text, chr(10), ''))) * 1000000 + (length(text) - length(replace(text, '.', ''))) * 100000 + least(length(text), 99999) AS c FROM documents)
SELECT source, doc_id, CAST(c AS BIGINT) AS completeness FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, doc_id) AS r FROM a) WHERE r = 1""",
    "text_choice": f"SELECT page, CASE WHEN b >= a + 0.08 THEN 'prefer_ocr' WHEN a >= b + 0.08 THEN 'keep_embedded' ELSE 'manual_review' END AS choice FROM (SELECT page, max(score) FILTER (WHERE pass = 'literal') AS a, max(score) FILTER (WHERE pass <> 'literal') AS b FROM {derived_values('drafts')} GROUP BY page)",
    "newest_first": "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY last_seen DESC, user_id LIMIT 80",
}
