"""Evidence from documents that a question names: segments scored, seeds with their neighbours first, a bounded number of each document.

``segments`` has ``qid, cid, provision, chunk, label, text``: parts of the documents that a question is anchored in. A segment's score is its relevance for what the
question asks beside the documents it names, with bonuses for analysis, for forms, and three points for each form field that it explains. The
best segments that explain a field are seeds; they and the chunks beside them come first, others fill up what is left.

Null texts are empty. Questions without tokens score by fields alone. Ties go by provision, then by chunk. Documents without segments have no rows, an empty table
has an empty result. Everything is windows over a (question, document)'s segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import policies as P
from quillon.operators import retrieval as R
from quillon.operators.pairs import BLOCK

#: How documents are named in a question, and other words that say nothing about its matter.
NAMED = [
    r"\b(?:nghi dinh|thong tu|nghi quyet|quyet dinh|luat|nd|tt|nq|qd)\s*(?:so\s*)?\d{1,4}(?:\s*[/-]\s*20\d{2})?(?:\s*[/-]\s*(?:nd-cp|tt-[a-z0-9-]+|nq-[a-z0-9-]+|qd-[a-z0-9-]+|qh\d*|ubtvqh\d*))?",
    r"\b\d{1,4}\s*[/-]\s*20\d{2}(?:\s*[/-]\s*(?:nd-cp|tt-[a-z0-9-]+|nq-[a-z0-9-]+|qd-[a-z0-9-]+|qh\d*|ubtvqh\d*))?\b", r"\b(?:theo|can cu|dua tren|van ban|duoc chi dinh lam can cu chinh)\b", r"\s+",
]
#: Questions on changes, on analysis and on forms, and what answers them.
CHANGES, CHANGED = r"\b(?:bo sung|sua doi|diem moi|thay the|bai bo|van ban bo sung)\b", r"\b(?:bo sung|sua doi|thay the|bai bo|quy dinh chi tiet|huong dan thi hanh)\b"
ANALYSIS, SCOPE = r"\b(?:phan tich|giai thich|tom tat|danh gia)\b", r"\b(?:pham vi dieu chinh|doi tuong ap dung|nguyen tac|trach nhiem|hieu luc thi hanh)\b"
ASKS_FORM, FORM, FIELD = r"\b(?:chi tieu|to khai|mau|bieu mau|khau tru|ke khai)\b", r"\b(?:chi tieu|to khai|mau so|bieu mau|khau tru|ke khai)\b", r"\[\s*\d{1,3}\s*\]|(?:^|\n|\|)\s*\d{1,3}\s*\|"
#: Seeds of a document, segments of a document, excerpts of an answer, points for a field; fields that a question may ask for.
SEEDS, SEGMENTS, EXCERPTS, POINTS, FIELDS = 5, 12, 6, 3, 12


def matter(normalised: Column) -> Column:
    """What a question is about, without the documents that it names; the whole of it if nothing else is left."""
    rest = F.trim(T.replace_all(normalised, [(p, " ") for p in NAMED]))
    return F.when(rest == "", normalised).otherwise(rest)


def fields_of(normalised: Column) -> Column:
    """Numbers of form fields that a question asks for, else all its small numbers."""
    named = P.field_numbers(normalised)
    plain = F.array_distinct(F.filter(F.regexp_extract_all(T.replace_all(normalised, [(p, " ") for p in NAMED]), F.lit(r"\b(\d{1,3})\b"), F.lit(1)).cast("array<int>"), lambda n: n > 0))
    return F.slice(F.when(F.size(named) > 0, named).otherwise(plain), 1, FIELDS)


def field_hits(text: Column, fields: Column) -> Column:
    """How many of the fields a text explains: in brackets, behind the word for a field, or as the first cell or number of a line."""
    def said(n: Column) -> Column:
        return F.rlike(text, F.concat(F.lit(r"(?iu)(?:\[\s*"), n, F.lit(r"\s*\]|\bchỉ\s*tiêu\s*\[?\s*"), n, F.lit(r"\s*\]?\b|(?:^|\n|\|)\s*"), n, F.lit(r"\s*(?:\||[.)]|$))")))

    # a text without a field's digits doesn't explain it: no pattern is made for it
    return F.size(F.filter(F.transform(fields, lambda n: n.cast("string")), lambda n: F.contains(text, n) & said(n)))


def scored(segments: DataFrame, queries: DataFrame) -> DataFrame:
    """``segments`` with ``hits`` and ``score``; ``queries`` (``qid, query``) is a stated set."""
    asked = queries.select("qid", T.once(T.normalise_query(F.col("query"))).alias("n")).select("qid", T.once(matter(F.col("n"))).alias("q"), fields_of(F.col("n")).alias("fields"))
    asked = asked.withColumn("q_tokens", T.distinct_tokens(T.tokens_of(F.col("q"))))
    # what a question asks for is found once, not for each of its segments
    for name, pattern in (("asks_form", ASKS_FORM), ("asks_change", CHANGES), ("asks_scope", ANALYSIS)):
        asked = asked.withColumn(name, T.once(F.col("q").rlike(pattern)))
    # a stated set meets the segments where they are: shuffled by question, each question's segments would be one task's
    asked = F.broadcast(asked) if queries.count() <= BLOCK else asked
    rows = segments.withColumn("text", F.coalesce("text", F.lit(""))).join(asked, "qid")
    rows = rows.withColumn("c", T.once(T.normalise_query(F.concat_ws(" ", "label", "text"))))
    # a text without any of the question's tokens in it is not cut into its own
    held = F.array_contains("q_tokens", T.SYNONYM) | F.exists("q_tokens", lambda t: F.contains("c", t))
    shared = F.when(held, F.size(F.array_intersect("q_tokens", T.distinct_tokens(T.tokens_of(F.col("c")))))).otherwise(0)
    rows = rows.withColumn("shared", T.once(shared)).withColumn("hits", T.once(field_hits(F.col("text"), F.col("fields"))))
    q, c, shared = F.col("q"), F.col("c"), F.col("shared")
    words = F.when(shared > 0, R.relevance_score(q, F.size("q_tokens"), shared, (F.length(q) > 3) & F.contains(c, q), R.flags_of(c))).otherwise(0.0)
    bonus = lambda test, x: F.when(test, x).otherwise(0.0)
    form = bonus(F.col("asks_form"), bonus(T.normalise_query(F.col("text")).rlike(FORM), 1.1) + bonus(F.col("text").rlike(FIELD), 0.9))
    score = words + bonus(F.col("asks_change") & c.rlike(CHANGED), 2.4) + bonus(F.col("asks_scope") & c.rlike(SCOPE), 0.9) + form + F.col("hits") * POINTS
    return rows.withColumn("score", F.round(score, 6)).select(*segments.columns, "hits", "score")


def evidence(rows: DataFrame) -> DataFrame:
    """Of each (question, document): at most ``SEGMENTS`` of the scored segments, with ``place`` and whether they are a ``seed`` or ``beside`` one."""
    document = Window.partitionBy("qid", "cid")
    order = [F.desc("hits"), F.desc("score"), F.col("provision"), F.col("chunk")]
    line = Window.partitionBy("qid", "cid", "provision").orderBy("chunk")
    rows = rows.withColumn("rank", F.row_number().over(document.orderBy(*order))).withColumn("seed", (F.col("hits") > 0) & (F.col("rank") <= SEEDS))
    next_to = lambda step: F.coalesce(step("seed").over(line) & (F.abs(step("chunk").over(line) - F.col("chunk")) == 1), F.lit(False))
    rows = rows.withColumn("beside", (next_to(F.lag) | next_to(F.lead)) & ~F.col("seed")).withColumn("first", F.col("seed") | F.col("beside"))
    rows = rows.withColumn("taken", F.row_number().over(document.orderBy(F.desc("first"), "rank"))).withColumn("must", F.sum(F.col("first").cast("int")).over(document))
    rows = rows.where(F.col("taken") <= F.greatest(F.lit(SEGMENTS), F.col("must"))).withColumn("place", F.row_number().over(document.orderBy("rank")))
    return rows.where(F.col("place") <= SEGMENTS).drop("taken", "must", "first", "rank")


def answers(chosen: DataFrame, limit: int = 900, least: int = 421) -> DataFrame:
    """``qid, excerpts``: the best ``EXCERPTS`` segments of each question, whatever their document, one for each text."""
    same = Window.partitionBy("qid", "text").orderBy(F.desc("hits"), F.desc("score"), "cid", "provision", "chunk")
    rows = chosen.where("hits > 0 OR score > 0").withColumn("copy", F.row_number().over(same)).where("copy = 1")
    order = Window.partitionBy("qid").orderBy(F.desc("hits"), F.desc("score"), "cid", "provision", "chunk")
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= EXCERPTS)
    line = F.concat("label", F.lit("\n"), T.compact_excerpt(F.col("text"), limit, least))
    return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]).alias("excerpts"))
