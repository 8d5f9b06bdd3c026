"""Selections and smaller predicates: variants, matches, order checks, greedy distinctness, acceptance, ranked choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.segments import _let as let
from quillon.operators.pairs import with_queries
from quillon.operators.etl import token_set

#: Terms of questions whose answers need a second source.
HIGH_RISK = r"\b(?:dieu kien|ap dung|hien hanh|con hieu luc|het hieu luc|mien|khong chiu|khong phai nop|bao nhieu|muc phat|thoi han|han nop|thue suat|nguong)\b"
#: Intents that make a question high-risk whatever its words.
HIGH_RISK_INTENTS = [
    "thuế suất, mức thuế và cách tính",
    "ngưỡng doanh thu, miễn thuế, không chịu thuế",
    "thời hạn khai, nộp và xử lý",
    "xử phạt, tiền chậm nộp và cưỡng chế",
    "sửa đổi, bổ sung, thay thế và đối chiếu",
]
#: Fixed value: words and suffixes of document types.
TYPE_WORDS = r"\b(?:nghi dinh|thong tu|nghi quyet|quyet dinh|luat|nd-cp|tt-btc|nd|tt|nq|qd)\b"


def variants(hints: DataFrame, query: str, cap: int = 6) -> DataFrame:
    """Search variants of document look-ups: the text, type with number, and type, number and remaining words in several orders."""
    clean = T.squeeze(F.col(query))
    rest = F.regexp_replace(F.regexp_replace(F.col("normalised"), r"\b\d{1,4}\s*[/-]\s*20\d{2}\s*[/-]\s*(?:nd-cp|tt-[a-z0-9-]+|nq-[a-z0-9-]+|qd-[a-z0-9-]+|qh\d*|ubtvqh\d*)\b", " "), TYPE_WORDS, " ")
    tokens = F.filter(F.split(rest, r"\s+"), lambda w: (w != "") & ~w.isin("so", "nam") & ~F.coalesce(w == F.col("number"), F.lit(False)) & ~F.coalesce(w == F.col("year"), F.lit(False)))
    rows = hints.withColumn("rest", F.array_join(tokens, " ")).withColumn("id", F.concat_ws("/", "number", F.when(F.col("number").isNotNull(), F.col("year"))))
    t, i, r = F.col("type"), F.col("id"), F.col("rest")
    join = lambda *parts: F.concat_ws(" ", *parts)
    numbered = F.when(F.col("number").isNotNull(), F.array(join(t, i), join(t, F.lit("số"), i)))
    described = F.when(F.col("number").isNotNull() & (r != ""), F.array(join(t, i, r), join(t, r, i), join(r, t, i))).when(r != "", F.array(join(t, r), r))
    empty = F.array().cast("array<string>")
    every = F.when(F.col("asks_question") | t.isNull(), F.array(clean)).otherwise(F.concat(F.array(clean), F.coalesce(numbered, empty), F.coalesce(described, empty)))
    return rows.select("qid", F.slice(F.array_distinct(F.filter(every, lambda v: v != "")), 1, cap).alias("variants"))


def hint_matches(hints: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that carry a hint's number, as a whole number, and its year. The hints are the stated query set."""
    rows = with_queries(candidates, hints.where("number IS NOT NULL").select("qid", "number", "year"), hints.count())
    text = T.normalise_plain(F.concat_ws(" ", "document_number", "title"), "a-z0-9/_.-")
    whole = F.rlike(text, F.concat(F.lit(r"(?:^|[^0-9])"), "number", F.lit(r"(?:[^0-9]|$)")))
    return rows.where(whole & (F.col("year").isNull() | F.contains(text, F.col("year")))).select("qid", "cid")


def backward_jumps(rows: DataFrame, group: str, order: str, number: Column) -> DataFrame:
    """Places where a sequence of numbers goes back."""
    line = Window.partitionBy(group).orderBy(order)
    numbered = rows.withColumn("number", number).where(F.col("number").isNotNull()).withColumn("before", F.lag("number").over(line))
    return numbered.where(F.col("number") < F.col("before")).select(group, order, "before", "number")


def high_risk(plans: DataFrame) -> Column:
    """Questions without a cited document that have a high-risk intent or term; ``plans`` as from ``question_plans``."""
    return F.col("asks") & ~F.col("cites") & (F.arrays_overlap("intents", F.array(*map(F.lit, HIGH_RISK_INTENTS))) | F.col("normalised").rlike(HIGH_RISK))


def greedy_distinct(items: Column, similar: float, cap: int | None = None) -> Column:
    """Items in order, without those that are too like one kept before, at most ``cap``; a fold within the row over token sets made once."""
    pairs = F.transform(items, lambda x: F.struct(x.alias("item"), token_set(x, 3).alias("tokens")))
    start = F.filter(pairs, lambda x: F.lit(False))

    def like(a: Column, b: Column) -> Column:
        """``jaccard`` of two sets above ``similar``; sizes alone rule most pairs out, and the size of a union follows from that of what is shared."""
        n, m, shared = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
        return F.when((n == 0) & (m == 0), F.lit(1.0 > similar)).when(F.least(n, m) / F.greatest(n, m) <= similar, False).otherwise(let(shared, lambda x: x / (n + m - x) > similar))

    def step(kept: Column, now: Column) -> Column:
        drop = F.exists(kept, lambda k: like(k["tokens"], now["tokens"]))
        if cap is not None:
            drop = drop | (F.size(kept) >= cap)
        return F.when(drop, kept).otherwise(F.concat(kept, F.array(now)))

    return F.transform(F.aggregate(pairs, start, step), lambda x: x["item"])


def recent_repeats(lines: DataFrame, group: str, order: str, text: str, back: int = 4) -> DataFrame:
    """Lines that equal one of the ``back`` lines before, normalised."""
    key = T.normalise_plain(F.col(text), "a-z0-9")
    line = Window.partitionBy(group).orderBy(order)
    rows = lines.withColumn("key", key)
    seen = F.lit(False)
    for n in range(1, back + 1):
        seen = seen | F.coalesce(F.lag("key", n).over(line) == F.col("key"), F.lit(False))
    return rows.withColumn("repeat", seen & (F.col("key") != ""))


def contained(source: Column, excerpt: Column, least: int = 12) -> Column:
    """Whether a source holds an excerpt, white space and case aside."""
    plain = lambda c: F.lower(T.squeeze(c))
    return (F.length(plain(excerpt)) >= least) & F.contains(plain(source), plain(excerpt))


def most_complete(docs: DataFrame, group: str, articles: Column, chapters: Column, length: Column, key: str) -> DataFrame:
    """The most complete document of each group: articles before chapters before length."""
    score = articles.cast("bigint") * 1_000_000 + chapters.cast("bigint") * 100_000 + F.least(length, F.lit(99_999))
    return docs.groupBy(group).agg(F.max_by(key, F.struct(score, -F.col(key))).alias(key), F.max(score).alias("completeness"))


def recommend(embedded: Column, recognised: Column) -> Column:
    """Which of two scored texts of a page to use."""
    return F.when(recognised >= embedded + 0.08, "prefer_ocr").when(embedded >= recognised + 0.08, "keep_embedded").otherwise("manual_review")
