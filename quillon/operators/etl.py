"""Document ETL: quality gates, scores, cleaning, structure, coverage and metadata, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T


def signal_count(text: Column, signals: list[str], opening: int = 12_000) -> Column:
    """How many of the signal phrases stand in the opening, folded."""
    head = T.squeeze(T.fold(F.left(text, F.lit(opening))))
    total = F.lit(0)
    for s in signals:
        total = total + head.contains(s).cast("int")
    return total


def share_in(text: Column, pattern: str) -> Column:
    """Matches of a pattern by the text's length."""
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.lit(1), F.length(text))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def extraction_score(text: Column, method: Column, markers: str) -> Column:
    """Base of the method, plus length and structure markers, minus replacement characters, in [0, 1]."""
    base = F.when(method == "ocr", 0.6).when(method == "docx", 0.58).when(method == "doc", 0.56).when(method == "pdf_text", 0.52).when(method == "html", 0.42).otherwise(0.5)
    n = F.length(text)
    score = base + F.least(F.lit(1.0), n / 8000.0) * 0.2 + F.least(F.lit(1.0), F.regexp_count(text, F.lit(markers)) / 8.0) * 0.22 - share_in(text, "�") * 20
    return F.when(method == "ocr_required", 0.2).otherwise(clamp(score))


def readability_score(text: Column, markers: str, marks: str, suspicious: str) -> Column:
    """Length, structure, accented letters, readable share and lines, minus a penalty for suspicious runs, in [0, 1]."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    n = F.length(text)
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) >= 8))
    readable = clamp(count(r"[\p{L}\d]") / F.greatest(F.lit(1), n) / 0.72)
    penalty = clamp(count(suspicious) * 4 / F.greatest(F.lit(20), n) * 8)
    score = 0.08 + clamp(n / 1400.0) * 0.25 + clamp(count(markers) / 5.0) * 0.26 + clamp(count(marks) / 24.0) * 0.15 + readable * 0.16 + clamp(lines / 12.0) * 0.1 - penalty * 0.35
    return F.when(n == 0, 0.0).otherwise(clamp(score))


def token_set(text: Column, least: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(T.fold(text), "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def neighbour_similarity(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Jaccard and overlap similarity of each text with the one before it in its group."""
    rows = rows.withColumn("tokens", token_set(F.col(text)))
    before = F.lag("tokens").over(Window.partitionBy(group).orderBy(order))
    rows = rows.withColumn("before", before).where(F.col("before").isNotNull())
    shared = F.size(F.array_intersect("tokens", "before"))
    return rows.select(group, order, jaccard(F.col("tokens"), F.col("before")).alias("jaccard"), (shared / F.greatest(F.lit(1), F.size("tokens"), F.size("before"))).alias("overlap"))


def page_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Trimmed non-blank lines with their place, and the place from the end."""
    lines = F.filter(F.transform(F.split(T.tidy(F.col(text)), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select(doc, page, lines.alias("lines")).withColumn("n", F.size("lines"))
    return rows.select(doc, page, "n", F.posexplode("lines").alias("at", "line"))


def edge_key(line: Column) -> Column:
    """A line for comparison across pages: digits as #."""
    return F.trim(F.regexp_replace(F.regexp_replace(T.fold(line), r"\d+", "#"), "[^a-z#]+", " "))


def drop_repeated_edges(pages: DataFrame, doc: str, page: str, text: str, edge: int = 2) -> DataFrame:
    """Drop lines that stand at the first or last ``edge`` lines of at least two thirds (and two) of a document's pages, everywhere in its pages.

    Edge lines alone are counted (a few for each page); lines are joined to the repeated ones, a small table, by document and key.
    """
    lines = page_lines(pages, doc, page, text).withColumn("key", edge_key(F.col("line")))
    edges = lines.where((F.col("at") < edge) | (F.col("at") >= F.col("n") - edge)).where(F.length("key").between(3, 90))
    total = pages.groupBy(F.col(doc).alias("of_doc")).agg(F.count(F.lit(1)).alias("pages"))
    often = edges.groupBy(doc, "key").agg(F.count_distinct(page).alias("seen")).join(total, F.col(doc) == F.col("of_doc")).where((F.col("pages") >= 2) & (F.col("seen") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.67))))
    kept = lines.join(often.select(doc, "key"), [doc, "key"], "left_anti")
    texts = kept.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts"))
    texts = texts.select(doc, page, F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))
    return pages.select(doc, page).join(texts, [doc, page], "left").select(doc, page, F.coalesce("text", F.lit("")).alias("text"))


def ranges(rows: DataFrame, group: str, number: str, width: int = 65_536) -> DataFrame:
    """Gaps and islands: the runs of consecutive numbers of each group.

    Runs are found within spans of ``width`` numbers, so that a group with most of the rows is spread over tasks; only runs that
    touch an end of their span, two a span at most, are then put together across spans."""
    at = F.col(number)
    rows = rows.select(group, number).where(at.isNotNull()).distinct().withColumn("span", F.floor(at / width))
    island = at - F.row_number().over(Window.partitionBy(group, "span").orderBy(number))
    runs = rows.withColumn("island", island).groupBy(group, "span", "island").agg(F.min(number).alias("first"), F.max(number).alias("last"))
    edge = (F.col("first") == F.col("span") * width) | (F.col("last") == F.col("span") * width + (width - 1))
    line = Window.partitionBy(group).orderBy("first")
    joined = runs.where(edge).withColumn("opens", F.coalesce((F.lag("last").over(line) + 1 != F.col("first")).cast("int"), F.lit(1)))
    joined = joined.withColumn("run", F.sum("opens").over(line)).groupBy(group, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.where(~edge).select(group, "first", "last").unionByName(joined.select(group, "first", "last"))


def batches(rows: DataFrame, group: str, number: str, size: int) -> DataFrame:
    """Consecutive batches of ``size`` by rank within the group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(number)) - 1
    return rows.withColumn("batch", F.floor(rank / size)).groupBy(group, "batch").agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("first"), F.max(number).alias("last"))


def page_selection(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Page numbers of selections such as ``1-3, 7`` (ranges in either direction, several dashes), distinct and sorted."""
    spec = F.regexp_replace(F.col(text), r"\s*[-–—]\s*", "-")
    parts = F.filter(F.split(spec, r"[,;\s]+"), lambda p: p != "")
    each = rows.select(key, F.explode(parts).alias("part"))
    first, last = F.regexp_extract("part", r"^(\d{1,4})", 1).try_cast("int"), F.regexp_extract("part", r"(\d{1,4})$", 1).try_cast("int")
    pages = each.where(F.col("part").rlike(r"^\d{1,4}(-\d{1,4})?$")).select(key, F.explode(F.sequence(F.least(first, last), F.greatest(first, last))).alias("page")).where(F.col("page") >= 1)
    return pages.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ",").alias("pages"))


#: Article headings; white space after the number crosses the line end, as it does in the published behaviour.
ARTICLE = r"(?imu)^\s*Điều\s+(\d+[a-zA-Z]?)\s*[.:]?\s*([^\n]*)$"
SENTINEL = "\x01"


def articles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Preamble and articles of each document, in order; a document without articles is one part."""
    marked = F.regexp_replace(T.tidy(F.col(text)), ARTICLE, SENTINEL + "$1\x02$2" + SENTINEL)
    parts = docs.select(key, F.posexplode(F.split(marked, SENTINEL)).alias("at", "part"))
    # odd parts are headings, the part behind a heading is its body, part 0 is the preamble
    line = Window.partitionBy(key).orderBy("at")
    rows = parts.withColumn("body", F.lead("part").over(line)).withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy(key)))
    heading = lambda n: F.get(F.split("part", "\x02"), F.lit(n))
    article = rows.where(F.col("at") % 2 == 1).select(key, F.lit("article").alias("kind"), heading(0).alias("article"), F.nullif(F.trim(heading(1)), F.lit("")).alias("heading"), T.tidy(F.col("body")).alias("body"), ((F.col("at") + 1) / 2 * 100).cast("int").alias("order_index"))
    lead = rows.where((F.col("at") == 0) & (T.tidy(F.col("part")) != ""))
    lead = lead.select(key, F.when(F.col("parts") == 1, "other").otherwise("preamble").alias("kind"), F.lit(None).cast("string").alias("article"), F.lit(None).cast("string").alias("heading"), T.tidy(F.col("part")).alias("body"), F.lit(0).alias("order_index"))
    return article.unionByName(lead)


def official_date(text: Column) -> Column:
    """The first valid date: ISO, then day/month/year, then written out; invalid days are no dates."""
    def made(pattern: str, groups: tuple[int, int, int]) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, g) for g in groups)
        iso = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return F.when(text.rlike(pattern), F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))

    return F.coalesce(
        made(r"\b(20\d{2})-(\d{1,2})-(\d{1,2})\b", (1, 2, 3)), made(r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](20\d{2})\b", (3, 2, 1)),
        made(r"(?i)\bng[àÀ]y\s+(\d{1,2})\s+th[áÁ]ng\s+(\d{1,2})\s+n[ăĂ]m\s+(20\d{2})\b", (3, 2, 1)),
    )


def best_metadata(rows: DataFrame) -> DataFrame:
    """Of each field, the non-null value of the highest authority, first row first."""
    rank = lambda c: F.when(F.col(c).isNotNull(), F.struct("authority", -F.col("ord")))
    return rows.groupBy("number").agg(*[F.max_by(c, rank(c)).alias(c) for c in ("title", "issued", "effective")])


def best_draft(drafts: DataFrame, tie: float = 0.015) -> DataFrame:
    """Of the drafts within ``tie`` of a page's best score: consensus first, then the longest text, then the pass's name."""
    best = F.max("score").over(Window.partitionBy("page"))
    near = drafts.withColumn("best", best).where(F.col("best") - F.col("score") <= tie + 1e-12)
    order = Window.partitionBy("page").orderBy((F.col("pass") != "consensus").cast("int"), F.length("text").desc(), "pass")
    return near.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("page", "pass", "score")


def coverage(docs: DataFrame, key: str, text: str, categories: dict[str, str]) -> DataFrame:
    """Categories that a text shows, those whose evidence is missing, and the covered share; one pass, no join."""
    docs = docs.select(key, T.once(T.fold(F.col(text))).alias("folded"))
    folded = F.col("folded")
    shown = F.array_compact(F.array(*[F.when(folded.rlike(p), F.lit(name)) for name, p in categories.items()]))
    rows = docs.select(key, shown.alias("shown"), F.split(folded, r"[.\n]").alias("sentences"))
    long_ = F.filter("sentences", lambda s: F.length(F.trim(s)) >= 35)
    covered = F.array_compact(F.array(*[F.when(F.exists(long_, _matcher(p)), F.lit(name)) for name, p in categories.items()]))
    rows = rows.withColumn("covered", F.array_intersect(covered, "shown"))
    score = F.when(F.size("shown") == 0, 1.0).otherwise(F.round(F.size("covered") / F.size("shown"), 3))
    return rows.select(key, "shown", F.array_except("shown", "covered").alias("missing"), score.alias("score"))


def _matcher(pattern: str):
    return lambda s: s.rlike(pattern)


#: Lines of certification, of scanners, of decoration, page numbers, and words of logos inside lines.
STAMP, STAMP_DAY, STAMP_TIME = r"(?iu)^\s*SAO\s+Y\s*;", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
SIGNED_BY = r"(?iu)^(?:digitally signed by|signed by|ký bởi|người ký|thời gian ký)\s*:"
SCANNED_BY, DECORATION = r"(?i)^(?:scanned by|scan by|camscanner|adobe scan|microsoft lens)\b", r"^[\s_─━—–\-=*·•.]{5,}$"
EDGE_NUMBER = r"(?i)^(?:(?:trang|page)\s*)?\d{1,4}(?:\s*[/|]\s*\d{1,4})?\.?$"
LOGO, WATERMARK = r"(?iu)(?:^|[\s(\[{:;,-])LOGO(?=$|[\s)\]}:;,.!?-])", r"(?iu)\bWATERMARK\b"


def without_logos(line: Column) -> Column:
    """A line without the words of logos and watermarks."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, LOGO.replace(r"(?:^|[\s(\[{:;,-])", " "), " "), LOGO, ""), WATERMARK, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, " {2,}", " "), r"\s+([,.;:!?])", "$1"))


def artifact_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of certification, scanners, decoration and edge page numbers dropped, words of logos taken out; counts and flags of what went."""
    lines = F.transform(F.split(T.tidy(F.col(text)), "\n"), lambda x: F.trim(x))
    rows = docs.select(key, lines.alias("lines")).withColumn("n", F.size("lines")).select(key, "n", F.posexplode("lines").alias("at", "line"))
    line, edge = F.col("line"), (F.col("at") <= 2) | (F.col("at") >= F.col("n") - 3)
    certified = (line.rlike(STAMP) & line.rlike(STAMP_DAY) & line.rlike(STAMP_TIME)) | line.rlike(SIGNED_BY)
    flag = (
        F.when(certified, "certification_metadata").when(line.rlike(SCANNED_BY), "scanner_metadata").when(line.rlike(DECORATION), "decorative_lines")
        .when(edge & line.rlike(EDGE_NUMBER), "page_numbers")
    )
    rows = rows.withColumn("flag", flag).withColumn("tokens", F.when(F.col("flag").isNull(), F.regexp_count(line, F.lit(LOGO)) + F.regexp_count(line, F.lit(WATERMARK))).otherwise(0))
    rows = rows.withColumn("left", F.when(F.col("flag").isNull(), without_logos(line)))
    flags = F.array_sort(F.array_union(F.collect_set("flag"), F.when(F.sum("tokens") > 0, F.array(F.lit("logo_or_watermark"))).otherwise(F.array().cast("array<string>"))))
    return rows.groupBy(key).agg(
        F.count("flag").alias("removed"), F.sum("tokens").cast("long").alias("tokens"), F.array_join(flags, ",").alias("flags"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("left") != "", F.struct("at", "left")))), lambda p: p["left"]), "\n")).alias("kept_md5"),
    )


def validate_pages(pages: DataFrame, doc: str, page: str, text: str, score: str, least: int = 40, floor: float = 0.62) -> DataFrame:
    """Coverage of page numbers 1..max, missing pages, lowest score and the verdict of each document; one aggregation."""
    good = F.length(F.trim(F.col(text))) >= least
    rows = pages.groupBy(doc).agg(F.max(page).alias("total"), F.collect_set(F.when(good, F.col(page))).alias("covered"), F.min(score).alias("lowest"))
    missing = F.array_except(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1), F.col("total"))), "covered")
    rows = rows.withColumn("missing", missing)
    warnings = F.array_compact(F.array(F.when(F.size("missing") > 0, "pages"), F.when(F.col("lowest") < floor, "score")))
    return rows.select(doc, "total", F.size("covered").alias("n_covered"), F.array_join(F.array_sort("missing").cast("array<string>"), ",").alias("missing"), F.round("lowest", 6).alias("lowest"), F.array_join(warnings, ",").alias("warnings"))


def first_missing(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Length of the contiguous prefix 0, 1, 2, ... of each document's pages."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1
    return pages.select(doc, page).distinct().withColumn("rank", rank).groupBy(doc).agg(F.count(F.when(F.col("rank") == F.col(page), 1)).alias("prefix"))


def evidence_window(rows: DataFrame, group: str, order: str, hit: Column) -> DataFrame:
    """Rows that match or stand beside a match: neighbours by lag and lead, not by a self-join."""
    line = Window.partitionBy(group).orderBy(order)
    rows = rows.withColumn("hit", hit)
    near = F.col("hit") | F.coalesce(F.lag("hit").over(line), F.lit(False)) | F.coalesce(F.lead("hit").over(line), F.lit(False))
    return rows.withColumn("near", near).where("near")


#: Signals of the notification classifier.
TITLE_SIGNALS = """quan ly thue|dang ky thue|ma so thue|nguoi nop thue|khai thue|ke khai thue|nop thue|hoan thue|khau tru thue|quyet toan thue|no thue|cuong che thue|hoa don dien tu|le phi mon bai|thue gia tri gia tang|thue thu nhap doanh nghiep|thue thu nhap ca nhan|thue tieu thu dac biet|thue bao ve moi truong|thue tai nguyen|thue su dung dat|thue xuat khau|thue nhap khau|bieu thue|thue nha thau|thue toi thieu toan cau""".split("|")
CONTENT_SIGNALS = TITLE_SIGNALS + "co quan thue|nghia vu thue|tien thue|mien thue|giam thue|gia tinh thue|thu nhap chiu thue|doi tuong chiu thue|chung tu dien tu".split("|")
EXCLUDED = """phu hieu|cap hieu|trang phuc|bien hieu|chuc nang nhiem vu|chuc nang quyen han|co cau to chuc|vi tri viec lam|bien che|tuyen dung|bo nhiem|luan chuyen|dao tao boi duong|thi dua khen thuong|ky luat cong chuc|tien luong|cong chuc thue|quan ly tai san|tai san cong|mua sam cong|dau thau|ke toan|kiem toan|ngan sach nha nuoc|chung khoan|bao hiem|dang ky doanh nghiep""".split("|")


def classify_notifications(rows: DataFrame) -> DataFrame:
    """Exclusions before title signals before two distinct content signals; and whether the document is fresh or backfilled."""
    # titles and bodies are normalised once, not for each signal, and bodies only where they decide
    rows = rows.select("*", T.once(T.normalise_plain(F.col("title"), "a-z0-9")).alias("_title"))
    title, body = F.col("_title"), T.normalise_plain(F.coalesce("body", F.lit("")), "a-z0-9")
    found = lambda text, signals: F.filter(F.array(*map(F.lit, signals)), lambda s: F.contains(text, s))
    out, named = F.size(found(title, EXCLUDED)), F.size(found(title, TITLE_SIGNALS))
    legal = F.concat_ws(" ", T.normalise_plain(F.coalesce("kind", F.lit("")), "a-z0-9"), title).rlike("luat|nghi dinh|thong tu|nghi quyet|quyet dinh|van ban")
    by_title = F.when(out > 0, "excluded_topic").when((named > 0) | title.rlike(r"(?:^|\s)thue(?:\s|$)"), "tax_title")
    rows = rows.select("*", T.once(by_title).alias("_by_title"))
    rows = rows.select("*", T.once(F.when(F.col("_by_title").isNull() & legal, body)).alias("_body"))
    reason = F.coalesce("_by_title", F.when(F.size(found(F.col("_body"), CONTENT_SIGNALS)) >= 2, "tax_content"), F.lit("insufficient_tax_evidence"))
    age = F.unix_timestamp(F.try_to_timestamp("published")) - F.unix_timestamp(F.try_to_timestamp(F.concat("issued", F.lit("T00:00:00Z"))))
    fresh = F.when(age <= 3 * 86_400, "fresh_document").otherwise("backfilled_full_text")
    return rows.withColumn("reason", reason).withColumn("eligible", F.col("reason").isin("tax_title", "tax_content")).withColumn("freshness", fresh).drop("_title", "_by_title", "_body")
