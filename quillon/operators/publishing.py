"""What has to hold before a text is published and what a reader is told: validators, legal blocks, answers by state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import etl as E

#: Phrases of a portal's frame in a folded opening; the first two are looked up in the opening as it is.
SHELL_WORDS = [r"(?i)\benglish\b", "中文"]
SHELL_PHRASES = ["trang chu chinh phu", "nuoc chxhcn viet nam", "thu dien tu cong vu chinh phu", "bao dien tu chinh phu", "lai chau", "dien bien", "tuyen quang"]
#: Structure marks of legal texts, type words, and the mark of an unreadable place.
GATE_MARKS = r"(?imu)^\s*(?:Điều|Chương|Mục)\s+[0-9IVXLC]+"
LEGAL_MARKS = r"(?imu)^\s*(?:Điều|Chương|Mục|Khoản)\s+[0-9IVXLC]+"
ARTICLE_NUMBER = r"(?imu)^\s*Điều\s+(\d+)[a-zA-Z]?\s*[.:]\s*(?=\S)"
#: Type words as the patterns find them, whose word boundaries know ASCII alone: behind THÔNG TƯ a boundary is a letter or digit.
_TYPES = r"(?:^|[^A-Za-z0-9_])(?:THÔNG TƯ[A-Za-z0-9_]|(?:{})(?:$|[^A-Za-z0-9_]))"
GATE_WORDS = ["NGHỊ ĐỊNH", "LUẬT", "NGHỊ QUYẾT"]
LEGAL_WORDS = [*GATE_WORDS, "QUYẾT ĐỊNH"]
GATE_TYPES, LEGAL_TYPES = _TYPES.format("|".join(GATE_WORDS)), _TYPES.format("|".join(LEGAL_WORDS))
UNREADABLE = r"(?iu)\[không đọc rõ\]"
#: Word-processor control characters, in order.
CONTROL_RULES = [("\r\x07", "\n"), ("\x07(\r?\n)", "\n$1"), ("\x07\\z", "\n"), ("\x07", "\t"), ("\x0b", "\n"), ("\r\n?", "\n"), ("\xa0", " ")]
#: Wrappers of page transcripts, in order.
WRAPPER_RULES = [
    ("(?iu)```(?:text|markdown)?", ""),
    (r"(?imu)^\s*(?:KẾT QUẢ OCR|BẢN CHÉP|TRANSCRIPTION)\s*:?[ \t]*$", ""),
    (r"(?imu)^\s*(?:---\s*)?(?:TRANG|PAGE)\s+\d+(?:\s*/\s*\d+)?(?:\s*---)?\s*$", ""),
    (r"(?imu)^\s*\[?không có nội dung\]?\s*$", ""),
    ("\r\n?", "\n"), ("[\t\xa0]+", " "), (" {2,}", " "), ("\n{3,}", "\n\n"),
]
#: What a reading voice leaves out or says in words, in order.
SPEECH_RULES = [
    (r"(?imu)^\s*\[/?TABLE\]\s*$", " "), (r"(?iu)\[không có nội dung chữ\]", " "), (UNREADABLE, "không đọc rõ"),
    ("☑|✓|✔", " ô đã đánh dấu "), ("□|☐", " ô chưa đánh dấu "), (r"\|", ", "), ("[_─━—–=-]{5,}", " "),
    (r"[\s\x0b\xa0]+([,.;:!?])", "$1"), ("([,.;:!?])", "$1 "), (r"[\s\x0b\xa0]+", " "), (r"^[,;:\s]+|[,;:\s]+$", ""),
]
#: Headers that hold the parts of an invoice's key, in the key's order.
INVOICE_HEADERS = {
    "seller": "mst nguoi ban|ma so thue nguoi ban|mst ban",
    "symbol": "ky hieu hoa don|ky hieu",
    "number": "so hoa don|so h don|^so$",
    "date": "ngay hoa don|ngay lap",
}
#: Bonuses by age in years, and of amending and detailing texts.
YEAR_BONUS = {0: 3.2, 1: 1.7, 2: 0.7}
OLD_YEARS, OLD_MALUS = 5, -0.55
AMENDS, DETAILS = r"\b(?:sua doi bo sung|thay the|bai bo)\b", r"\b(?:quy dinh chi tiet|huong dan thi hanh)\b"
#: Confidence of an answer by the state of the document's ingestion.
STATE_CONFIDENCE = {"ready": 0.99, "processing": 0.82, "needs_review": 0.76, "failed": 0.58}
#: Rank of the kinds of update.
UPDATE_RANK = {"replacement": 3, "amendment": 2, "repeal": 1}


def strip(text: Column) -> Column:
    return T.strip(text)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def has_type(text: Column, words: list[str]) -> Column:
    """``rlike`` of the pattern ``_TYPES`` of ``words``, a word at a time: a plain search first, then a pattern that begins with the word, since one that begins with
    alternatives tries them at each character, which takes thirty times as long."""
    whole = lambda w, end: F.contains(text, F.lit(w)) & text.rlike(f"{w}(?<![A-Za-z0-9_]{w}){end}")
    return reduce(Column.__or__, [whole("THÔNG TƯ", "[A-Za-z0-9_]"), *(whole(w, "(?![A-Za-z0-9_])") for w in words)])


def shell_opening(text: Column) -> Column:
    """The folded opening that ``portal_shell`` looks for phrases in."""
    return T.squeeze(T.fold(F.left(text, F.lit(12_000))))


#: What a prefix of a folded text can't be taken with: dropped marks move places, and a capital sigma's small letter hangs on what follows.
MOVES = "[\u0300-\u036fΣ]"


def folded_prefix(text: Column, folded: Column, n: int, length: Column | None = None) -> Column:
    """``fold`` of the first ``n`` characters, from the folded text where that is the same; ``folded`` has them all. ``length`` is that of the text, if it was found once."""
    return F.when((F.length(text) if length is None else length) <= n, folded).when(text.rlike(MOVES), T.fold(F.left(text, F.lit(n)))).otherwise(F.left(folded, F.lit(n)))


def portal_shell(text: Column, folded: Column | None = None, least: int = 4) -> Column:
    """Whether the opening of a text holds at least ``least`` of nine signals of a portal's frame. ``folded`` is its ``shell_opening``, if it was made once for all phrases."""
    opening = F.left(text, F.lit(12_000))
    folded = shell_opening(text) if folded is None else folded
    signals = [opening.rlike(p) for p in SHELL_WORDS] + [folded.contains(p) for p in SHELL_PHRASES]
    return sum((s.cast("int") for s in signals), F.lit(0)) >= least


def shell_in(text: Column, whole: Column, length: Column) -> Column:
    """``portal_shell`` of a text whose folded opening, not squeezed, is in ``whole``: only where that has all words of enough phrases, phrases are looked for."""
    words = [reduce(Column.__and__, [F.contains(whole, F.lit(w)) for w in sorted(p.split(), key=len, reverse=True)]) for p in SHELL_PHRASES]
    maybe = sum((w.cast("int") for w in words), F.lit(0)) >= 4 - len(SHELL_WORDS)
    return F.when(maybe, T.let(T.squeeze(folded_prefix(text, whole, 12_000, length)), lambda f: portal_shell(text, f))).otherwise(False)


def names(whole: Column, wanted: Column) -> Column:
    """Whether a folded text names a folded number, white space aside; where it stands as it is, white space needn't be taken out."""
    return F.contains(whole, wanted) | F.contains(T.unspaced(whole), wanted)


def dated(head: Column, dates: Column) -> Column:
    """Whether a folded text holds one of the spellings of a date, runs of white space aside: as it stands, or squeezed if it has the year at all. No spelling has two blanks together, so one that is found as it stands is found squeezed."""
    said = lambda text: F.exists(dates, lambda d: F.contains(text, d))
    return said(head) | (F.contains(head, F.right(F.get(dates, F.lit(0)), F.lit(4))) & T.let(T.squeeze(head), said))


def opening(text: Column, length: Column, n: int) -> Column:
    """The first ``n`` characters of a text, which isn't copied if it has no more."""
    return F.when(length <= n, text).otherwise(F.left(text, F.lit(n)))


def structured(text: Column, length: Column) -> Column:
    """Whether a text has structure, or length with a type word."""
    return (count(text, GATE_MARKS) >= 2) | ((length >= 5_000) & has_type(text, GATE_WORDS))


def usable_text(text: Column, expected: Column) -> Column:
    """A gate before a text is used: long enough, no shell, its number in the opening, and structure or length with a type word."""
    text = F.coalesce(text, F.lit(""))
    wanted = T.number_key(F.coalesce(expected, F.lit("")))
    named = (wanted == "") | T.number_key(F.left(text, F.lit(20_000))).contains(wanted)
    return (F.length(text) >= 800) & structured(text, F.length(text)) & ~portal_shell(text) & named


def usable_texts(docs: DataFrame, key: str, text: Column, expected: str) -> DataFrame:
    """``key, usable`` of each text, which is made once; only long ones with structure are folded, and once."""
    rows = docs.select(key, T.number_key(F.coalesce(expected, F.lit(""))).alias("wanted"), T.once(text).alias("text"))
    text, whole, wanted, n = F.col("text"), F.col("whole"), F.col("wanted"), F.col("n")
    rows = rows.select("*", T.once(F.length(text)).alias("n"))
    rows = rows.select("*", T.once(F.when((n >= 800) & structured(text, n), T.fold(opening(text, n, 20_000)))).alias("whole"))
    named = (wanted == "") | names(whole, wanted)
    return rows.select(key, F.when(whole.isNull(), False).otherwise(named & ~shell_in(text, whole, n)).alias("usable"))


def date_signals(issued: Column) -> Column:
    """Spellings of a date ``20YY-MM-DD`` in folded texts; none for other values."""
    year, short_month, short_day = F.left(issued, F.lit(4)), F.ltrim(F.substring(issued, 6, 2), F.lit("0")), F.ltrim(F.substring(issued, 9, 2), F.lit("0"))
    long_month, long_day = F.substring(issued, 6, 2), F.substring(issued, 9, 2)
    slashed = [F.concat(d, F.lit("/"), m, F.lit("/"), year) for d, m in ((short_day, short_month), (long_day, long_month))]
    worded = [F.concat(F.lit("ngay "), d, F.lit(" thang "), m, F.lit(" nam "), year) for d in (short_day, long_day) for m in (short_month, long_month)]
    return F.when(issued.rlike(r"^20\d{2}-\d{2}-\d{2}$"), F.array(*slashed, *worded)).otherwise(F.array().cast("array<string>"))


def validate_texts(docs: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """All checks of a text before publication, as codes in a fixed order; a document without warnings is ready.

    ``docs`` has ``key, text, expected, issued, method, quality, total_pages``; ``pages`` has ``key, page, text, score, similarity``.
    Pages are aggregated by document before they are joined, and texts are checked before, so one join and one shuffle of pages do, and no text is shuffled.
    """
    total = F.greatest(F.lit(0), F.coalesce("total_pages", F.lit(0)))
    of = pages.groupBy(F.col(key).alias("of")).agg(
        F.collect_set(F.when(F.length(strip(F.col("text"))) >= 40, F.col("page"))).alias("good"), F.min(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))).alias("lowest"),
        F.max((F.col("similarity") > 0) & (F.col("similarity") < 0.72)).alias("apart"))
    text, small = F.col("text"), [key, "method", "quality", "total"]
    rows = docs.select(key, "method", "quality", total.alias("total"), T.number_key(F.coalesce("expected", F.lit(""))).alias("wanted"), date_signals(F.col("issued")).alias("dates"), T.once(strip(F.coalesce("text", F.lit("")))).alias("text"))
    rows = rows.select("*", T.once(F.length(text)).alias("n_chars"))
    rows = rows.select("*", T.once(T.fold(opening(text, F.col("n_chars"), 30_000))).alias("whole"))
    # what is asked of a text is searched only where it may be found: a numbered article is a mark
    whole, n, wanted, dates = F.col("whole"), F.col("n_chars"), F.col("wanted"), F.col("dates")
    numbers = F.regexp_extract_all(text, F.lit(ARTICLE_NUMBER), F.lit(1)).cast("array<int>")
    of_marks = lambda m: F.struct(
        m.alias("marks"), ((m < 2) & ~((n >= 5_000) & has_type(text, LEGAL_WORDS))).alias("structure"), F.when(m > 1, T.let(numbers, lambda x: F.array_sort(x) != x)).otherwise(False).alias("order"))
    of_text = F.struct(
        F.when(F.contains(text, F.lit("[")), count(text, UNREADABLE)).otherwise(0).alias("unreadable"), shell_in(text, whole, n).alias("shell"), ((wanted != "") & ~names(whole, wanted)).alias("number"),
        T.let(count(text, LEGAL_MARKS), of_marks).alias("of_marks"), F.when(F.size(dates) > 0, T.let(folded_prefix(text, whole, 20_000, n), lambda head: ~dated(head, dates))).otherwise(False).alias("date"))
    rows = rows.select(*small, "n_chars", T.once(of_text).alias("found")).select(*small, "n_chars", "found.*", "found.of_marks.*").join(of, F.col(key) == F.col("of"), "left")
    rows = rows.withColumn("covered", F.size(F.filter(F.coalesce("good", F.array().cast("array<int>")), lambda p: p.between(1, F.col("total")))))
    checks = {
        "short": F.col("n_chars") < 800,
        "shell": F.col("shell"),
        "number": F.col("number"),
        "date": F.col("date"),
        "structure": F.col("structure"),
        "quality": F.col("quality") < F.when(F.col("method") == "ocr", 0.68).otherwise(0.54),
        "pages": F.col("covered") < F.col("total"),
        "page_score": F.col("lowest") < 0.62,
        "unreadable": F.col("unreadable") > F.greatest(F.lit(2), F.ceil(F.greatest(F.lit(1), F.col("total")) * 0.15)),
        "disagreement": F.col("apart"),
        "order": F.col("order"),
    }
    rows = rows.withColumn("warnings", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items()))))
    return rows.select(key, F.array_join("warnings", ",").alias("warnings"), F.when(F.size("warnings") == 0, "ready").otherwise("needs_review").alias("status"), "n_chars", "marks", "covered", "lowest")


#: Lines that open a block, and lines that are a marker alone.
BLOCK_HEAD = r"^(?:CHƯƠNG|Chương|MỤC|Mục|PHẦN|Phần)\s+"
OPENS_BLOCK = r"(?iu)^(?:CHƯƠNG|MỤC|PHẦN)\s+|^\d+[.)]\s+|^[a-zđ][.)]\s+"
ONLY_MARKER = r"(?iu)^(?:\d+[.)]|[a-zđ][.)]|[-–—])$"
CLAUSE, POINT = r"^\d+[.)]\s+", r"(?iu)^[a-zđ][.)]\s+"


def legal_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines joined to headings, clauses, points and paragraphs. A marker alone opens a block that takes the next line whatever it is;
    blank lines close blocks. Islands over lines: a line opens a block or belongs to the one before."""
    raw = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "[\t\xa0]+", " "), "\n")
    rows = docs.select(key, F.posexplode(raw).alias("at", "line")).withColumn("line", T.squeeze(F.col("line")))
    order = Window.partitionBy(key).orderBy("at")
    line, before = F.col("line"), F.coalesce(F.lag("line").over(order), F.lit(""))
    marker = line.rlike(ONLY_MARKER)
    opens = marker | (before == "") | (line.rlike(OPENS_BLOCK) & ~before.rlike(ONLY_MARKER))
    kind = (
        F.when(marker, F.when(line.rlike(r"^\d"), "clause").otherwise("point"))
        .when(line.rlike(BLOCK_HEAD), "heading").when(line.rlike(CLAUSE), "clause").when(line.rlike(POINT), "point").otherwise("paragraph"))
    rows = rows.withColumn("opens", opens).withColumn("kind", kind).withColumn("block", F.sum(F.col("opens").cast("int")).over(order)).where("line <> ''")
    parts = rows.groupBy(key, "block").agg(F.min_by("kind", "at").alias("kind"), F.min("at").alias("first_line"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    return parts.select(key, "first_line", "kind", F.array_join(F.transform("lines", lambda p: p["line"]), " ").alias("text"))


def year_score(issued: Column, this_year: int) -> Column:
    """A bonus for the last three years, a malus from five years on."""
    age = F.lit(this_year) - F.left(issued, F.lit(4)).try_cast("int")
    score = F.when(age >= OLD_YEARS, OLD_MALUS)
    for years, bonus in YEAR_BONUS.items():
        score = score.when(age == years, bonus)
    return score.otherwise(0.0)


def amendment_score(text: Column) -> Column:
    plain = T.normalise_query(F.coalesce(text, F.lit("")))
    return F.when(plain.rlike(AMENDS), 2.2).when(plain.rlike(DETAILS), 0.35).otherwise(0.0)


def best_provisions(rows: DataFrame, document: str, provision: str, order: str, text: str, score: str, k: int = 3, least: int = 80) -> DataFrame:
    """The k best distinct (document, provision) of all: the best of each pair by aggregation, then a top-k without a global sort."""
    rows = rows.where(F.length(strip(F.col(text))) > least)
    best = rows.groupBy(document, provision).agg(F.max(F.struct(F.col(score), (-F.col(order)).alias("nth"))).alias("best"))
    best = best.select(document, provision, F.col("best")[score].alias(score), (-F.col("best")["nth"]).alias(order))
    return best.orderBy(F.col(score).desc(), order, document, provision).limit(k)


def latest_update(relations: DataFrame, target: str) -> DataFrame:
    """The update of each target that was issued last; among these by kind, then by score."""
    rank = F.coalesce(*(F.when(F.col("kind") == kind, n) for kind, n in UPDATE_RANK.items()))
    first = F.struct(F.coalesce("issued", F.lit("")).alias("day"), rank.alias("rank"), "score", "source")
    return relations.where(rank.isNotNull()).groupBy(target).agg(F.max(first).alias("first")).select(target, F.col("first.source").alias("source"), F.col("first.day").alias("issued"))


def merged_warnings(*lists: Column, most: int = 5) -> Column:
    """Distinct warnings of several lists in their order, at most five."""
    return F.slice(F.array_distinct(F.array_compact(F.flatten(F.array(*lists)))), 1, most)


def speech_queue(units: DataFrame, document: str, unit: str, texts: str, start: str) -> DataFrame:
    """The texts to be read from a document's start unit on; the start is clamped to its units."""
    most = F.max(unit).over(Window.partitionBy(document))
    first = F.greatest(F.lit(0), F.least(most, F.floor(start)))
    return units.withColumn("from", first).where(F.col(unit) >= F.col("from")).select(document, unit, F.posexplode(texts).alias("chunk", "text"))


def points_of(groups: DataFrame, points: DataFrame, ids: str, point: str) -> DataFrame:
    """The points that a group names, in its order; names without a point go."""
    return groups.select("*", F.posexplode(ids).alias("place", point)).drop(ids).join(points, point)


def invoice_key(headers: Column, row: Column) -> Column:
    """The key of an invoice row, seller|symbol|number|date, found by its headers; null with fewer than two columns or two values."""
    names = F.transform(headers, T.header_key)
    fits = lambda p: F.transform(names, lambda h: h.rlike(p))
    at = [F.coalesce(F.array_position(fits(p), True), F.lit(0)) for p in INVOICE_HEADERS.values()]
    parts = [T.header_key(F.get(row, (n - 1).cast("int"))) for n in at]
    known = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    return F.when((known([n > 0 for n in at]) >= 2) & (known([p != "" for p in parts]) >= 2), F.concat_ws("|", *parts))


def answers_by_state(states: DataFrame, missing: DataFrame, key: str, page: str, most: int = 8) -> DataFrame:
    """What a reader is told by the state of ingestion: accepted revisions first, then the state; with the missing pages as ranges."""
    runs = E.ranges(missing, key, page).select(F.col(key).alias("of"), F.struct("first", "last").alias("run"))
    runs = runs.groupBy("of").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    accepted = F.coalesce(F.col("accepted") & (F.upper("revision_number") == F.upper(key)), F.lit(False))
    answer = F.when(accepted, "ready").when(F.col("state").isin("processing", "needs_review", "failed"), F.col("state"))
    confidence = F.coalesce(*(F.when(F.col("answer") == s, c) for s, c in STATE_CONFIDENCE.items()))
    named = F.transform(F.slice("runs", 1, most), lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat(r["first"].cast("string"), F.lit("–"), r["last"].cast("string"))))
    shown = F.concat(F.array_join(named, ", "), F.when(F.size("runs") > most, ", …").otherwise(""))
    rows = states.withColumn("answer", answer).where("answer IS NOT NULL").join(runs, F.col(key) == F.col("of"), "left")
    return rows.select(key, "answer", confidence.alias("confidence"), F.when(F.col("answer") == "ready", "").otherwise(F.coalesce(shown, F.lit(""))).alias("missing"))


def video_decision(rows: DataFrame, start: str, enabled: bool = True) -> DataFrame:
    """An ordered ladder: the first reason that speaks against an automatic video, or eligible."""
    day = F.lit(start[:10])
    published, rollout = F.try_to_timestamp("published"), F.try_to_timestamp(F.lit(start))
    reason = (
        F.when(~F.lit(enabled), "disabled").when(~F.col("accepted"), "not_accepted").when(published.isNull() | (published < rollout), "before_rollout")
        .when(F.col("issued").isNull() | (F.col("issued") < day), "old_issued_document").when(~F.col("eligible"), "not_tax_document")
        .when(F.length(strip(F.col("text"))) < 1_500, "insufficient_text").when(~F.col("capable"), "pipeline_not_ready").otherwise("eligible"))
    return rows.withColumn("reason", reason)
