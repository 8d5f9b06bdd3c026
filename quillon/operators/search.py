"""The whole search: hints, discovery on the index, source scores, ambiguity, documents that open, evidence, answer and confidence.

``sources`` has ``cid, number, title, type, issuer, issued, url, body``. A query asks a question or names a document. Of the sources that the
index finds, a look-up opens the first one that carries its number, a question the first four of twelve; texts that are too short don't
open. A look-up without a year that several documents answer is ambiguous. A question is answered by excerpts of the nearest provisions,
one for a (document, provision), newer and amending documents first.

Everything behind the index works on rows of (query, found source): at most ``found`` for a query, so nothing is paired beyond that.
Queries that find nothing answer with no document. Null numbers, titles and dates are empty; ties go to the smaller key, among provisions
to the earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import index as I
from quillon.operators import publishing as P
from quillon.operators import retrieval as R
from quillon.operators.pairs import BLOCK
from quillon.sources.shared import written

#: Sources that a look-up and a question may open, how many they do, and the least characters of a text that opens.
OPENS, OPENED, LEAST = {False: 7, True: 12}, {False: 1, True: 4}, 800
#: Confidence of each kind of response.
CONFIDENCE = {"ambiguous": 0.92, "none": 0.35, "numbered": 0.9, "named": 0.78, "excerpts": 0.72}
CONFLICT_CAP = 0.38


def number_match(text: Column, number: Column) -> Column:
    """Whether a text has a number as a whole number, or one that a slash follows."""
    return F.rlike(text, F.concat(F.lit("(?:^|[^0-9])"), number, F.lit("(?:/|[^0-9]|$)")))


def exact_match(rows: DataFrame) -> Column:
    """Whether a source carries the number, year and type of a hint, as far as the hint has them."""
    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("title"), F.lit(""))
    number, kind = T.normalise_query(filled("source_number")), T.normalise_query(filled("source_type"))
    return (
        (F.col("number").isNull() | number_match(number, F.col("number"))) & (F.col("year").isNull() | F.contains(number, F.col("year")))
        & (F.col("type").isNull() | F.contains(kind, T.normalise_query(F.col("type"))))
    )


def source_scores(found: DataFrame, this_year: int) -> DataFrame:
    """``found`` (hints beside sources, with ``relevance``) with ``exact`` and the composite ``score``: relevance of the text and of its
    description, bonuses for number, year, type and an exact match, and for questions those of date and amendment."""
    rows = found.withColumn("described", T.once(T.normalise_query(F.concat_ws(" ", "source_number", "source_type", "title", "url"))))
    rows = rows.withColumn("q_tokens", T.distinct_tokens(T.tokens_of(F.col("normalised")))).withColumn("c_tokens", T.once(T.distinct_tokens(T.tokens_of(F.col("described")))))
    shared = F.size(F.array_intersect("q_tokens", "c_tokens"))
    q, described = F.col("normalised"), F.col("described")
    own = F.when(shared > 0, R.relevance_score(q, F.size("q_tokens"), shared, (F.length(q) > 3) & F.contains(described, q), R.flags_of(described))).otherwise(0.0)
    bonus = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(0.0)
    rows = rows.withColumn("exact", exact_match(rows))
    score = (
        F.col("relevance") + own + bonus(number_match(described, F.col("number")), 2.5) + bonus(F.contains(described, F.col("year")), 1.8)
        + bonus(F.contains(described, T.normalise_query(F.col("type"))), 0.8) + bonus((F.coalesce("source_number", F.lit("")) != "") & F.col("exact"), 2.2)
        + F.when(F.col("asks_question"), P.year_score(F.col("issued"), this_year) + P.amendment_score(F.col("title"))).otherwise(0.0)
    )
    return rows.withColumn("score", F.round(score, 6)).drop("described", "q_tokens", "c_tokens")


def _ranked(rows: DataFrame, *order: Column, group: tuple[str, ...] = ("qid",), name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def same_document() -> Column:
    """What two sources of one document share: number and issuer."""
    return F.concat_ws(":", F.regexp_replace(T.normalise_query(F.coalesce("source_number", "title")), r"\s+", ""), T.normalise_query(F.coalesce("issuer", F.lit(""))))


def ambiguous(scored: DataFrame, most: int = 10) -> DataFrame:
    """``qid, choices``: of look-ups with a number and a type but no year, the distinct documents (number and issuer) that answer it, if several do."""
    rows = scored.where("number IS NOT NULL AND type IS NOT NULL AND year IS NULL AND NOT asks_question AND exact")
    first = _ranked(rows.withColumn("same", same_document()), F.desc("score"), F.col("cid"), group=("qid", "same"), name="nth").where("nth = 1")
    first = _ranked(first, F.desc("score"), F.col("cid")).where(F.col("place") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "cid"))), lambda x: x["cid"])
    return first.groupBy("qid").agg(listed.alias("choices")).where(F.size("choices") > 1)


def opened(scored: DataFrame, this_year: int) -> DataFrame:
    """``scored`` sources that open, in their order ``nth`` for the answer: a question's are ranked anew by their whole texts."""
    asks = F.col("asks_question")
    rows = _ranked(scored, F.desc("score"), F.col("cid")).where(F.col("place") <= F.when(asks, OPENS[True]).otherwise(OPENS[False]))
    rows = rows.where((F.length(P.strip(F.col("body"))) >= LEAST) & (F.col("exact") | asks))
    rows = _ranked(rows, F.col("place"), name="open").where(F.col("open") <= F.when(asks, OPENED[True]).otherwise(OPENED[False]))
    whole = F.concat_ws(" ", "source_number", "title", "body")
    rows = rows.withColumn("q_tokens", T.distinct_tokens(T.tokens_of(F.col("normalised")))).withColumn("c", T.once(T.normalise_query(whole)))
    rows = rows.withColumn("c_tokens", T.once(T.distinct_tokens(T.tokens_of(F.col("c"))))).withColumn("q", F.col("normalised"))
    shared = F.size(F.array_intersect("q_tokens", "c_tokens"))
    text = F.when(shared > 0, R.relevance_score(F.col("q"), F.size("q_tokens"), shared, (F.length("q") > 3) & F.contains("c", F.col("q")), R.flags_of(F.col("c")))).otherwise(0.0)
    rows = rows.withColumn("fit", F.when(asks, F.round(text + P.year_score(F.col("issued"), this_year) + P.amendment_score(F.col("title")), 6)).otherwise(0.0))
    return _ranked(rows, F.desc("fit"), F.col("open"), name="nth").drop("q", "c", "q_tokens", "c_tokens", "place", "open")


def provisions(docs: DataFrame, keys: list[str], text: str = "body") -> DataFrame:
    """Lines of texts as provisions in order; ``identifier`` counts them. (Documents with articles are cut by ``etl.articles``.)"""
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.trim(x) != "")
    return docs.select(*keys, F.posexplode(lines).alias("order_index", "official")).withColumn("identifier", F.concat(F.lit("Đoạn "), (F.col("order_index") + 1).cast("string")))


def provision_scores(rows: DataFrame, words: Column) -> DataFrame:
    """``rows`` of (query, provision) with the relevance of the provision's ``words``; 0 without a shared token."""
    rows = rows.withColumn("c", T.once(T.normalise_query(words))).withColumn("c_tokens", T.once(T.distinct_tokens(T.tokens_of(F.col("c")))))
    shared = F.size(F.array_intersect("q_tokens", "c_tokens"))
    q = F.col("normalised")
    score = R.relevance_score(q, F.size("q_tokens"), shared, (F.length(q) > 3) & F.contains("c", q), R.flags_of(F.col("c")))
    return rows.withColumn("words_score", F.when(shared > 0, score).otherwise(0.0)).drop("c", "c_tokens")


def evidence(documents: DataFrame, this_year: int, each: int = 10, answers: int = 3, least: int = 80) -> tuple[DataFrame, DataFrame]:
    """Of opened documents: the best ``each`` provisions of each (``qid, cid, place, identifier``), and the ``answers`` best distinct
    provisions of each query (``qid, place, excerpt``), where newer and amending documents weigh more."""
    asked = documents.where("asks_question").withColumn("q_tokens", T.distinct_tokens(T.tokens_of(F.col("normalised"))))
    base = (P.year_score(F.col("issued"), this_year) + P.amendment_score(F.col("title"))).alias("base")
    keys = ["qid", "cid", "normalised", "q_tokens", "source_number", "title", "nth", "base"]
    rows = provisions(asked.select("*", base), keys)
    own = provision_scores(rows, F.concat_ws(" ", "identifier", "official")).withColumn("own", F.round("words_score", 6)).drop("words_score")
    named = provision_scores(own, F.concat_ws(" ", "source_number", "title", "identifier", "official")).withColumn("total", F.round(F.col("words_score") + F.col("base"), 6))
    best = _ranked(named, F.desc("own"), F.col("order_index"), group=("qid", "cid")).where(F.col("place") <= each).select("qid", "cid", "place", "identifier", "own")
    long = named.where(F.length(P.strip(F.col("official"))) > least)
    order = (F.desc("total"), F.col("order_index"), F.col("nth"))
    first = _ranked(long, *order, group=("qid", "source_number", "identifier"), name="copy").where("copy = 1")
    first = _ranked(first, *order).where(F.col("place") <= answers)
    line = F.concat("source_number", F.lit(" — "), "identifier", F.lit("\n"), T.compact_excerpt(F.col("official"), 900, 421))
    return best, first.select("qid", "place", line.alias("excerpt"))


def search(queries: DataFrame, sources: DataFrame, index: I.Index, this_year: int, conflicts: DataFrame | None = None, found: int = 30, folder: str | None = None) -> DataFrame:
    """One response for each query: ``qid, kind, response, document, n_found, n_opened, choices, excerpts, confidence``.

    ``conflicts`` names queries (``qid``) whose sources contradict each other; without an opened document they cap the confidence. Scored sources and opened documents
    have several readers: they are written to ``folder`` once, if there is one, and found anew, with their texts, for each otherwise.
    """
    hints = R.search_hints(queries.withColumn("query", T.clean_user_query(F.col("query")))).select("qid", "normalised", "type", "number", "year", "asks_question")
    held = sources.select("cid", F.col("number").alias("source_number"), F.col("type").alias("source_type"), "title", "issuer", "issued", "url", "body")
    kept = (lambda df, name: written(df, f"{folder}/{name}")) if folder is not None else lambda df, name: df
    hits = I.search(index, queries, found).join(hints, "qid")
    # at most ``found`` for each of a stated set's queries: they meet the texts where these are, and no text is shuffled
    hits = held.join(F.broadcast(hits), "cid") if queries.count() <= BLOCK else hits.join(held, "cid")
    scored = kept(source_scores(hits, this_year), "scored")
    several = ambiguous(scored)
    documents = kept(opened(scored, this_year), "opened")
    _, excerpts = evidence(documents, this_year)
    again = _ranked(documents.withColumn("rest", F.col("nth") > 1).withColumn("same", same_document()), F.col("nth"), group=("qid", "rest", "same"), name="copy")
    others = F.when(F.col("rest") & (F.col("copy") == 1), F.struct("nth", "cid"))
    per = again.groupBy("qid").agg(F.min_by("cid", "nth").alias("document"), F.count(F.lit(1)).alias("opened"), F.transform(F.array_sort(F.collect_list(others)), lambda x: x["cid"]).alias("others"))
    said = excerpts.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "excerpt"))), lambda x: x["excerpt"]).alias("excerpts"))
    counts = scored.groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    marked = (conflicts if conflicts is not None else queries.select("qid").limit(0)).select("qid", F.lit(True).alias("conflict")).distinct()
    rows = hints.join(counts, "qid", "left").join(several, "qid", "left").join(per, "qid", "left").join(said, "qid", "left").join(marked, "qid", "left")
    asks, none = F.col("asks_question"), F.col("document").isNull()
    response = F.when(F.col("choices").isNotNull(), "ambiguous").when(none, "none").when(asks, "excerpts").when(F.col("number").isNotNull(), "numbered").otherwise("named")
    rows = rows.withColumn("response", response)
    plain = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("response"))
    capped = F.when(F.coalesce("conflict", F.lit(False)) & F.col("response").isin("ambiguous", "none"), F.least(plain, F.lit(CONFLICT_CAP))).otherwise(plain)
    listed = F.coalesce("choices", F.when(asks, F.slice("others", 1, 5))).cast("array<string>")
    text = F.coalesce(F.array_join(listed, ","), F.lit(""))
    return rows.select(
        "qid", F.when(asks, "question").otherwise("document").alias("kind"), "response", F.when(F.col("response") != "ambiguous", F.col("document")).alias("document"),
        F.coalesce("found", F.lit(0)).cast("long").alias("n_found"), F.coalesce("opened", F.lit(0)).cast("long").alias("n_opened"), text.alias("choices"),
        F.when(F.col("response") == "excerpts", F.md5(F.array_join("excerpts", "\n\n"))).alias("excerpts_md5"), capped.alias("confidence"),
    )
