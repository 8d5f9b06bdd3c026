"""Storyboards: evidence for every category that a document shows, chosen within a length, in scenes with titles of their own.

A category that a document shows, but none of its points, gets its first sentence that matches. Points are chosen by greedy set cover: the
one with the most categories not yet covered that still fits the length, then the most important, then the shortest; what is left of the length goes to the
most important of the others, if they aren't nearly the same as a chosen one. The choice is a fold over a document's points, at most
``most`` of them, best ones first with one of each category; how many sentences a document has doesn't matter.

Null and empty texts show nothing and have an opening scene alone. Ties go by place. Repeated keys stay apart only as far as their keys do. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.segments import _let as let
from quillon.functions.segments import pack
from quillon.sources.shared import written

#: Words that a phrase doesn't end with, phrases that say nothing to a reader, and where clauses begin.
OPEN_ENDS = r"(?iu)(?<![\p{L}\d])(?:và|hoặc|đồng thời|tại|trong|của|với|theo|để|do|bởi|từ|quản|trụ)$"
LOW_VALUE = r"(?iu)kết quả (?:phân tích|đánh giá|phân loại).*(?:chỉ là|là) căn cứ hỗ trợ|không thay thế trách nhiệm ban hành quyết định hành chính|trách nhiệm ban hành quyết định hành chính|căn cứ hỗ trợ cơ quan thuế nhưng không thay thế"
CLAUSES = r"(?iu)(?<=[;:.!?])\s+|\s+(?=(?:hoặc|đồng thời|nếu|khi|trường hợp|sau khi|trước khi)(?![\p{L}\d]))"
MARKS = r"(?iu)[ăâđêôơưà-ỹ]"
#: Seconds, fewest and most scenes, and most points of a length; characters read in a second.
LENGTHS = {"brief": (80, 6, 9, 18), "standard": (170, 9, 14, 32), "detailed": (300, 14, 20, 48)}
SPEED, SIMILAR, IN_SCENE = 14, 0.8, 3


def clean(text: Column) -> Column:
    """One space between words, none before marks, no repeated marks, no dots at the end."""
    rules = [(r"\s+", " "), (r"\s+([,.;:!?])", "$1"), (r"([.!?])(?:\s*[.!?])+", "$1"), (r"([,;:])(?:\s*[,;:])+", "$1"), (r"(?:…|\.{3,})$", "")]
    return F.trim(T.replace_all(text, rules))


def complete_phrase(text: Column, most: int = 138, marked: bool = True) -> Column:
    """Whether a cleaned text can stand by itself: long and short enough, not cut off, three words or a number, and worth showing; ``marked`` asks for the language's marks in longer texts."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    fits = F.length(text).between(12, most) & ~text.rlike(r"…|\.{3,}") & ~text.rlike(r"[,;:]$") & ~text.rlike(OPEN_ENDS) & (text.rlike("[0-9]") | (words >= 3)) & ~text.rlike(LOW_VALUE)
    return fits & ((F.length(text) < 20) | text.rlike(r"^[A-Z0-9/ .:–—-]+$") | text.rlike(MARKS)) if marked else fits


def phrases(text: Column, most: int = 105) -> Column:
    """Clauses of a text; longer ones are packed from their words."""
    parts = F.transform(F.split(clean(text), CLAUSES), lambda c: F.regexp_replace(clean(c), r"(?iu)^(?:hoặc|đồng thời)\s+", ""))
    return F.flatten(F.transform(F.filter(parts, lambda c: c != ""), lambda c: F.when(F.length(c) <= most, F.array(c)).otherwise(pack(F.split(c, " "), most))))


def short_phrase(text: Column, most: int, marked: bool = True) -> Column:
    """A text if it can stand by itself, else its first sentence or clause that can, else the text."""
    def first(parts: Column) -> Column:
        return F.get(F.filter(F.transform(parts, clean), lambda p: complete_phrase(p, most, marked)), F.lit(0))

    return let(clean(text), lambda c: F.when(complete_phrase(c, most, marked), c).otherwise(F.coalesce(first(F.split(c, r"(?<=[.!?])\s+")), first(phrases(c, most)), c)))


def sentence_points(docs: DataFrame, key: str, text: str, categories: list[tuple[str, str]], least: int = 35, longest: int = 420) -> DataFrame:
    """``key, nth, claim, covers, importance``: sentences with all categories that they show, the first two more important."""
    parts = F.split(F.regexp_replace(T.squeeze(F.coalesce(F.col(text), F.lit(""))), r"([.!?;:])\s+", "$1\x01"), "\x01")
    good = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: F.length(s).between(least, longest))
    rows = docs.select(F.col(key).alias("key"), F.posexplode(good).alias("nth", "claim"))
    covers = F.array_compact(F.array(*[F.when(F.col("claim").rlike(p), F.lit(name)) for name, p in categories]))
    return rows.withColumn("covers", covers).withColumn("importance", F.when(F.col("nth") < 2, 4).otherwise(3))


def repaired(docs: DataFrame, points: DataFrame, key: str, text: str, categories: list[tuple[str, str]], least: int = 12) -> DataFrame:
    """``points`` with a point for each category that a document shows and none of its points does: its first sentence that matches, less important, behind the others."""
    body = F.coalesce(F.col(text), F.lit(""))
    shown = F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(name)) for name, p in categories]))
    parts = F.split(F.regexp_replace(T.squeeze(body), r"([.!?;:])\s+", "$1\x01"), "\x01")
    sentences = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: F.length(s) >= least)
    # sentences are cut once, and searched only for what the document shows
    first = let(F.struct(sentences.alias("sentences"), shown.alias("shown")), lambda d: F.array_compact(F.array(*[_first(d, name, p) for name, p in categories])))
    have = points.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("have"), F.max("nth").alias("last"))
    rows = docs.select(F.col(key).alias("key"), shown.alias("shown"), first.alias("first")).join(have.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")), "left")
    lost = F.array_except("shown", F.coalesce("have", F.array().cast("array<string>")))
    extra = rows.select("key", F.coalesce("last", F.lit(-1)).alias("last"), F.posexplode(F.filter("first", lambda f: F.array_contains(lost, f["name"]))).alias("at", "f"))
    extra = extra.select("key", (F.col("last") + 1 + F.col("at")).cast("int").alias("nth"), F.col("f.claim").alias("claim"), F.array("f.name").alias("covers"), F.lit(2).alias("importance"))
    return points.unionByName(extra)


def _first(document: Column, name: str, pattern: str) -> Column:
    """struct<name, claim>: the first of a document's sentences that shows a category; null if none does."""
    claim = F.get(F.filter(F.when(F.array_contains(document["shown"], name), document["sentences"]), lambda s: s.rlike(pattern)), F.lit(0))
    return let(claim, lambda s: F.when(s.isNotNull(), F.struct(F.lit(name).alias("name"), s.alias("claim"))))


def _similar(a: Column, b: Column) -> Column:
    """Share of the larger token set that two claims have in common."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def _alike(a: Column, b: Column) -> Column:
    """Whether two claims are nearly the same; those of unlike sizes need no comparison."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, (least / most > SIMILAR) & (_similar(a, b) > SIMILAR)).otherwise(False)


def chosen_points(points: DataFrame, most: int, budget: int) -> DataFrame:
    """``key, place, nth, claim, covers, importance, cost``: the points of each document chosen within ``budget`` characters, in the order of choice."""
    rows = points.withColumn("same", T.normalise_plain(F.concat_ws(" ", F.array_join("covers", " "), "claim"), "a-z0-9"))
    first = F.row_number().over(Window.partitionBy("key", "same").orderBy(F.desc("importance"), "nth"))
    rows = rows.withColumn("copy", first).where("copy = 1")
    # one of each category first, then the most important
    lead = F.explode_outer("covers")
    best = rows.select("key", "nth", "importance", F.length("claim").alias("n"), lead.alias("category")).where("category IS NOT NULL")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("key", "category").orderBy(F.desc("importance"), "n", "nth"))).where("r = 1").select("key", "nth").distinct().withColumn("lead", F.lit(True))
    rows = rows.join(best.toDF("of", "at", "lead"), F.col("key").eqNullSafe(F.col("of")) & (F.col("nth") == F.col("at")), "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("lead"), F.desc("importance"), "nth"))).where(F.col("r") <= most)
    tokens = F.array_distinct(F.filter(F.split(T.normalise_plain(F.col("claim"), "a-z0-9%"), " "), lambda t: F.length(t) > 2))
    fields = ["nth", "claim", "covers", "importance", "cost", "tokens"]
    point = F.struct("nth", "claim", "covers", "importance", F.length("claim").alias("cost"), tokens.alias("tokens"), F.lit(False).alias("near"))
    per = rows.groupBy("key").agg(F.array_sort(F.collect_list(point)).alias("points"))
    start = F.struct(
        F.array().cast(per.schema["points"].dataType).alias("out"), F.filter("points", lambda p: p["cost"] <= budget).alias("left"), F.array().cast("array<string>").alias("have"), F.lit(0).alias("spent"))

    def gain(p: Column, have: Column) -> Column:
        return F.size(F.array_except(p["covers"], have))

    # points that are left know whether they are like a chosen one, so that a step compares them with the last choice alone; those that can't be chosen any more
    # are left out for good, as gains only fall and what is spent only grows
    def onward(state: Column, best: Column) -> Column:
        def kept(now: Column) -> Column:
            fits = F.filter(state["left"], lambda p: (p["nth"] != best["nth"]) & (now["spent"] + p["cost"] <= budget))
            marked = F.transform(fits, lambda p: F.struct(*[p[f].alias(f) for f in fields], (p["near"] | _alike(best["p"]["tokens"], p["tokens"])).alias("near")))
            return F.filter(marked, lambda p: ~p["near"] | (gain(p, now["have"]) > 0))

        now = F.struct(F.array_union(state["have"], best["p"]["covers"]).alias("have"), (state["spent"] + best["cost"]).alias("spent"))
        return let(now, lambda n: F.struct(F.array_append(state["out"], best["p"]).alias("out"), kept(n).alias("left"), n["have"].alias("have"), n["spent"].alias("spent")))

    def step(state: Column, _: Column) -> Column:
        ranked = F.transform(state["left"], lambda p: F.struct((-gain(p, state["have"])).alias("gain"), (-p["importance"]).alias("importance"), p["cost"].alias("cost"), p["nth"].alias("nth"), p.alias("p")))
        return let(F.array_min(ranked), lambda best: F.when(best.isNull(), state).otherwise(onward(state, best)))

    out = F.aggregate(F.sequence(F.lit(1), F.size("points")), start, step, lambda s: s["out"])
    return per.select("key", F.posexplode(out).alias("place", "p")).select("key", (F.col("place") + 1).alias("place"), "p.nth", "p.claim", "p.covers", "p.importance", "p.cost")


def storyboards(docs: DataFrame, key: str, text: str, title: str, categories: list[tuple[str, str]], length: str = "standard", marked: bool = True, folder: str | None = None) -> DataFrame:
    """``key, scene, kind, category, title, points, narration``: an opening, scenes of up to three points of a category in the order of choice, and a closing one.

    Points and the chosen ones have several readers: they are written to ``folder`` once, if there is one, and found anew for each otherwise.
    """
    kept = (lambda df, name: written(df, f"{folder}/{name}")) if folder is not None else lambda df, name: df
    seconds, _, scenes, most = LENGTHS[length]
    points = kept(repaired(docs, sentence_points(docs, key, text, categories), key, text, categories), "points")
    chosen = kept(chosen_points(points, most, seconds * SPEED), "chosen")
    rows = chosen.withColumn("category", F.coalesce(F.get("covers", F.lit(0)), F.lit("overview")))
    # a category's points, three to a scene, in the order in which the first of them was chosen
    nth = F.floor((F.row_number().over(Window.partitionBy("key", "category").orderBy("place")) - 1) / IN_SCENE)
    said = lambda c: F.when(c.rlike("[.!?]$"), c).otherwise(F.concat(c, F.lit(".")))
    groups = rows.withColumn("group", nth).groupBy("key", "category", "group").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "nth", F.col("claim").alias("claim")))).alias("points"))
    groups = groups.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where(F.col("r") <= scenes - 2)
    heading = short_phrase(F.get("points", F.lit(0))["claim"], 72, marked)
    heading = F.when(F.length(heading).between(12, 78), heading).otherwise(F.concat(F.lit("Nội dung: "), "category"))
    body = groups.select("key", (F.col("r") + 1).alias("scene"), F.lit("body").alias("kind"), "category", T.once(heading).alias("title"), F.transform("points", lambda p: p["nth"]).alias("points"), F.array_join(F.transform("points", lambda p: said(clean(p["claim"]))), " ").alias("narration"))
    again = F.row_number().over(Window.partitionBy("key", F.lower("title")).orderBy("scene"))
    body = body.withColumn("again", again).withColumn("title", F.when(F.col("again") > 1, F.concat("title", F.lit(" ("), F.col("again").cast("string"), F.lit(")"))).otherwise(F.col("title"))).drop("again")
    none = F.array().cast("array<int>")
    opening = docs.select(F.col(key).alias("key"), F.lit(1).alias("scene"), F.lit("intro").alias("kind"), F.lit("overview").alias("category"), clean(F.coalesce(F.col(title), F.lit(""))).alias("title"), none.alias("points"), said(clean(F.coalesce(F.col(title), F.lit("")))).alias("narration"))
    ends = rows.withColumn("r", F.row_number().over(Window.partitionBy("key", "category").orderBy(F.desc("importance"), "place"))).where("r = 1")
    ends = ends.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("importance"), "place"))).where(F.col("r") <= IN_SCENE)
    ends = ends.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "nth", "claim"))).alias("points")).where(F.size("points") >= 2)
    closing = ends.select("key", F.lit(scenes).alias("scene"), F.lit("summary").alias("kind"), F.lit("overview").alias("category"), F.lit("Ba tác động trực tiếp cần ghi nhớ").alias("title"), F.transform("points", lambda p: p["nth"]).alias("points"), F.array_join(F.transform("points", lambda p: said(clean(p["claim"]))), " ").alias("narration"))
    return opening.unionByName(body).unionByName(closing).withColumnRenamed("key", key)
