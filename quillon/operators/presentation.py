"""Documents for readers: preamble, articles, signature and appendix; and the preamble's fields.

The tail of a document begins at the first signature or appendix behind its first article; articles are cut from what stands before it, so that no line
is in two parts and none is lost. A preamble's fields (authority, motto, number, place and date, type, title, and the grounds) are found by
anchors; each one is looked for in what the ones before it have left.

Null and empty texts have no parts. Documents without articles are one part. Very long texts are cut inside their row. Repeated keys are kept
apart only as far as their keys are. An empty table gives an empty result; only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.segments import _let as let
from quillon.operators import blocks as B
from quillon.operators.etl import ARTICLE
from quillon.operators.listings import normalise_legal

#: Offices that sign, and how appendices begin.
OFFICES = "BỘ TRƯỞNG|THỦ TƯỚNG(?: CHÍNH PHỦ)?|CHỦ TỊCH|PHÓ CHỦ TỊCH|TỔNG CỤC TRƯỞNG|CỤC TRƯỞNG|TỔNG KIỂM TOÁN NHÀ NƯỚC|CHÁNH ÁN|VIỆN TRƯỞNG"
DEPUTY = r"(?:KT|TM|TL|TUQ)\.\s*"
SIGNATURES = [rf"(?iu)(?<=\.\s{{0,9}}/\.\s{{0,9}})(?=(?:{DEPUTY})?(?:{OFFICES})\b)", rf"(?idmu)^(?={DEPUTY}(?:{OFFICES})\b)", r"(?idmu)^(?=Nơi\s+nhận\s*:)"]
APPENDICES = [r"(?idmu)^(?=(?:PHỤ\s+LỤC|MẪU\s+SỐ|DANH\s+MỤC)\b)", r"(?iu)(?<=\s)(?=PHỤ\s+LỤC\s*\(\s*Kèm\s+theo\b)"]
#: Fixed value: words that a heading doesn't have.
SENTENCE = r"(?iu)[.;:]$|\b(?:là|được|quy định|bao gồm|thực hiện|có trách nhiệm|áp dụng|phải|không được)\b"
CONTINUED = "Nội dung tiếp theo · Trang "
SIGNED, APPENDED, OPENING = "Phần ký và nơi nhận", "Phụ lục", "Phần mở đầu"


def _at(text: Column, patterns: list[str]) -> Column:
    """Characters before the first place, behind the beginning, where one of the patterns holds; null if none does. The patterns match places, not characters."""
    return let(F.split(text, "|".join(f"(?:{p})" for p in patterns), 2), lambda p: F.when(F.size(p) > 1, F.length(F.get(p, F.lit(0)))))


def _cut(text: Column, at: Column) -> tuple[Column, Column]:
    return F.left(text, at), F.substring(text, at + 1, F.greatest(F.lit(0), F.length(text) - at))


def _headed(heading: Column, body: Column) -> Column:
    """struct<heading, body>: an article without a heading takes its first line, if that looks like one."""
    made = lambda h, b: F.struct(h.alias("heading"), b.alias("body"))

    def own(lines: Column) -> Column:
        first = F.get(lines, F.lit(0))
        words = F.size(F.filter(F.split(first, r"\s+"), lambda w: w != ""))
        fits = (F.size(lines) >= 2) & (F.length(first) <= 160) & words.between(2, 14) & ~first.rlike(SENTENCE)
        rest = normalise_legal(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n"))
        return F.when(fits, made(first, rest)).otherwise(made(F.lit(None).cast("string"), body))

    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(heading != "", made(heading, body)).otherwise(let(lines, own))


def parts(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """``key, kind, identifier, heading, text, order_index``, and the columns in ``more`` of the document: preamble, articles by hundreds, signature and appendix behind them."""
    docs = docs.select(F.col(key).alias("key"), F.struct(F.lit(0), *more).alias("more"), T.once(normalise_legal(F.coalesce(F.col(text), F.lit("")))).alias("text")).where("text <> ''")
    rows = docs.withColumn("marked", T.once(F.split(F.regexp_replace("text", ARTICLE, "\x01$1\x02$2\x01"), "\x01")))
    # what stands before the first article, and the rest
    head = F.get("marked", F.lit(0))
    rows = rows.withColumn("body", T.once(F.when(F.size("marked") > 1, F.substring("text", F.length(head) + 1, F.length("text"))).otherwise("")))
    rows = rows.withColumn("tail_at", T.once(_at(F.col("body"), SIGNATURES + APPENDICES)))
    rows = rows.withColumn("tail", F.when(F.col("tail_at").isNotNull(), normalise_legal(_cut(F.col("body"), F.col("tail_at"))[1])).otherwise(""))
    main = F.when(F.col("tail_at").isNotNull(), normalise_legal(F.concat(head, _cut(F.col("body"), F.col("tail_at"))[0]))).otherwise(F.col("text"))
    rows = rows.withColumn("pieces", T.once(F.split(F.regexp_replace(main, ARTICLE, "\x01$1\x02$2\x01"), "\x01")))
    n = F.floor((F.size("pieces") - 1) / 2).cast("int")
    none = F.lit(None).cast("string")

    def made(kind: str, identifier: Column, heading: Column, text: Column, order: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), identifier.alias("identifier"), heading.alias("heading"), text.alias("text"), order.cast("int").alias("order_index"))

    def article(i: Column) -> Column:
        mark = F.split(F.get("pieces", i * 2 - 1), "\x02")
        given = F.struct(F.get(mark, F.lit(0)).alias("number"), F.trim(F.get(mark, F.lit(1))).alias("heading"), normalise_legal(F.get("pieces", i * 2)).alias("body"))
        return let(given, lambda g: let(_headed(g["heading"], g["body"]), lambda h: made("article", F.concat(F.lit("Điều "), g["number"]), h["heading"], h["body"], i * 100)))

    opening = normalise_legal(F.get("pieces", F.lit(0)))
    begins = F.col("tail").rlike(r"(?iu)^(?:PHỤ\s+LỤC|MẪU\s+SỐ|DANH\s+MỤC)\b")
    rows = rows.withColumn("appendix_at", F.when(begins, 0).otherwise(_at(F.col("tail"), APPENDICES)))
    signed, appended = _cut(F.col("tail"), F.col("appendix_at"))
    signed = F.when(F.col("appendix_at").isNull(), F.col("tail")).otherwise(normalise_legal(signed))
    every = F.when(F.size("marked") <= 1, F.array(made("other", none, none, F.col("text"), F.lit(0)))).otherwise(F.concat(
        F.array(made("preamble", F.lit(OPENING), none, opening, F.lit(0))), F.transform(F.sequence(F.lit(1), n), article),
        F.array(made("other", F.lit(SIGNED), none, signed, (n + 1) * 100), made("other", F.lit(APPENDED), none, F.coalesce(normalise_legal(appended), F.lit("")), (n + 2) * 100)),
    ))
    return rows.select(F.col("key").alias(key), F.inline(F.filter(every, lambda p: (p["text"] != "") | (p["kind"] == "article"))), *[F.col("more")[c].alias(c) for c in more])


def main_provisions(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``parts`` of documents that are given as pages, with ``first_page``: their pages are joined in order; what stands before the first article is a preamble only
    if the first page is there, else it goes on from pages that aren't."""
    piece = F.struct(F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = pages.groupBy(doc).agg(F.min(page).alias("first_page"), F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "\n").alias("whole"))
    found = parts(whole, doc, "whole", "first_page")
    later = (F.col("kind") == "preamble") & (F.col("first_page") > 1)
    title = F.concat(F.lit(CONTINUED), F.col("first_page").cast("string"))
    return found.select(
        doc, F.when(later, "continuation").otherwise(F.col("kind")).alias("kind"), F.when(later, title).otherwise(F.col("identifier")).alias("identifier"), "heading", "text", "order_index", "first_page")


def reader_items(docs: DataFrame, key: str, text: str, folder: str | None = None) -> DataFrame:
    """``key, order_index, part, identifier, heading, place`` and the columns of ``blocks.build_blocks``: what a reader sees of each part, block by block, tables as rows."""
    part = F.struct(F.col("kind").alias("part"), "identifier", "heading").alias("about")
    named = parts(docs, key, text).select(F.struct(F.col(key).alias("of"), F.col("order_index").alias("nth")).alias("id"), "text", part)
    blocks = B.build_blocks(named, "id", "text", folder, "about")
    return blocks.select(F.col("id.of").alias(key), F.col("id.nth").alias("order_index"), "about.part", "about.identifier", "about.heading", "place", "kind", "text", "mark", "value", "level", "checked", "rows", "header_rows", "columns", "first_column")


# preambles

#: Lines of every document, types of documents and what their numbers say, authorities in their order.
NATION, MOTTO, LABEL = "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "Độc lập - Tự do - Hạnh phúc", r"(?iu)\bVĂN\s+BẢN\s+QUY\s+PHẠM\s+PHÁP\s+LUẬT\b"
TYPES = ["NGHỊ QUYẾT LIÊN TỊCH", "THÔNG TƯ LIÊN TỊCH", "NGHỊ ĐỊNH", "NGHỊ QUYẾT", "QUYẾT ĐỊNH", "THÔNG TƯ", "CHỈ THỊ", "PHÁP LỆNH", "LUẬT", "THÔNG BÁO", "CÔNG VĂN"]
TYPE_OF_NUMBER = [(r"/NĐ-CP(?![\p{L}\d])", "NGHỊ ĐỊNH"), (r"/TT-", "THÔNG TƯ"), (r"/NQ-", "NGHỊ QUYẾT"), (r"/QĐ-", "QUYẾT ĐỊNH"), (r"/QH\d*(?![\p{L}\d])", "LUẬT")]
AUTHORITY_OF_NUMBER = [
    (r"/(?:NĐ|NQ)-CP(?![\p{L}\d])", "CHÍNH PHỦ"), (r"/QĐ-TTG(?![\p{L}\d])", "THỦ TƯỚNG CHÍNH PHỦ"), (r"/TT-BTC(?![\p{L}\d])", "BỘ TÀI CHÍNH"), (r"/QH\d*(?![\p{L}\d])", "QUỐC HỘI"),
    (r"/UBTVQH\d*(?![\p{L}\d])", "ỦY BAN THƯỜNG VỤ QUỐC HỘI"),
]
AUTHORITIES = ["ỦY BAN THƯỜNG VỤ QUỐC HỘI", "THỦ TƯỚNG CHÍNH PHỦ", "BỘ TÀI CHÍNH", "TỔNG CỤC THUẾ", "CỤC THUẾ", "CHÍNH PHỦ", "QUỐC HỘI"]
NO_AUTHORITY, NO_TYPE = "CƠ QUAN BAN HÀNH", "VĂN BẢN"
NUMBER = r"(?iu)(?:LUẬT\s+)?Số\s*:\s*(\d{1,4}(?:\s*/\s*\d{4})?\s*/\s*[A-ZĐ0-9-]+)"
DATED = r"(?iu)(?:^|\s)([^,;\n]{2,55}),\s*ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
DATE_SPAN = r"(?iu)[^,;\n]{0,55},\s*ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"
GROUNDS = r"(?:Căn\s+cứ|Theo\s+đề\s+nghị|Xét\s+đề\s+nghị|Theo\s+đề\s+xuất)(?=\s|$|[,:;.])"


def _undecorated(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, LABEL, " "), r"[_━─—-]{3,}", " "), r"\s+", " "))


def _spaced(words: str) -> str:
    """A pattern for words with any white space between."""
    return words.replace(" ", r"\s+")


def _type_at(header: Column, kind: str) -> Column:
    """Characters before a type's words in a header; null if they aren't there."""
    words, ends = _spaced(kind), r"(?=\s|$|[:.–—-])"
    return F.when(header.rlike(rf"(?iu)(?:^|\s){words}{ends}"), F.length(F.regexp_extract(header, rf"(?isu)^(.*?(?:^|\s)){words}{ends}", 1)))


def preamble(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, authority, nation, motto, number, dateline, type, title, grounds``: the fields of each preamble, in their order; ``grounds`` has its legal grounds one by one."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "[\t\xa0]+", " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = docs.select(F.col(key).alias("key"), T.once(F.array_join(lines, "\n")).alias("whole")).where("whole <> ''")
    # the grounds begin at a line, else anywhere
    pieces = F.split("whole", rf"(?idmu)^(?={GROUNDS})", 2)
    inside = F.split("whole", r"(?iu)(?=Căn\s+cứ(?:\s|$|[,:;.]))", 2)
    at_once = F.col("whole").rlike(rf"(?iu)^{GROUNDS}")
    head = F.when(at_once, "").when(F.size(pieces) > 1, F.get(pieces, F.lit(0))).otherwise(F.get(inside, F.lit(0)))
    rows = rows.withColumn("header", T.once(F.trim(head))).withColumn("body", F.trim(F.substring("whole", F.length(head) + 1, F.length("whole"))))
    # number
    number = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("header", NUMBER, 1), r"\s*/\s*", "/"), r"\s+", " "))
    rows = rows.withColumn("number", T.once(F.when(F.col("header").rlike(NUMBER), number))).withColumn("upper", F.upper(F.coalesce("number", F.lit(""))))
    # place and date: from a line with a date, else from the whole header
    dated = F.filter(F.split("header", "\n"), lambda x: x.rlike(r"(?iu),\s*ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"))
    rows = rows.withColumn("said", T.once(F.coalesce(F.get(dated, F.lit(0)), F.col("header"))))
    place = F.trim(F.regexp_replace(F.regexp_replace(_undecorated(F.regexp_extract("said", DATED, 1)), r"(?su).*(?:Hạnh phúc|HẠNH PHÚC)\s*", ""), r"(?isu).*(?:Số\s*:\s*\S+)\s*", ""))
    words = F.filter(F.split(place, " "), lambda w: w != "")
    place = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 5), F.lit(6)), " ")
    place = F.when((place == "") | place.rlike(r"(?iu)^(?:ngày|tháng|năm)$"), "").otherwise(F.concat(place, F.lit(", ")))
    part = lambda n: F.regexp_extract("said", DATED, n)
    dateline = F.concat(place, F.lit("ngày "), part(2).try_cast("int").cast("string"), F.lit(" tháng "), part(3).try_cast("int").cast("string"), F.lit(" năm "), part(4))
    rows = rows.withColumn("dateline", F.when(F.col("said").rlike(DATED), dateline))
    # type: what the number says, else the first one of the header
    clean = F.regexp_replace("header", LABEL, " ")
    rows = rows.withColumn("clean", T.once(clean))
    wanted = F.coalesce(*[F.when(F.col("upper").rlike(p), kind) for p, kind in TYPE_OF_NUMBER])
    places = F.array(*[F.struct(_type_at(F.col("clean"), kind).alias("at"), F.lit(-len(kind)).alias("longer"), F.lit(kind).alias("kind")) for kind in TYPES])
    rows = rows.withColumn("wanted", wanted).withColumn("places", T.once(F.array_sort(F.filter(places, lambda p: p["at"].isNotNull()))))
    first = F.when(F.col("wanted").isNotNull(), F.get(F.filter("places", lambda p: p["kind"] == F.col("wanted")), F.lit(0))).otherwise(F.get("places", F.lit(0)))
    rows = rows.withColumn("type_at", first["at"]).withColumn("type", F.coalesce("wanted", first["kind"], F.lit(NO_TYPE)))
    # authority: known ones in the lines before the fields and before the nation's name, a line in capitals, else what the number says
    structural = F.transform(F.split("header", "\n"), lambda x: x.rlike(r"(?iu)CỘNG\s+HÒA|Độc\s+lập|(?:LUẬT\s+)?Số\s*:|,\s*ngày\s+\d{1,2}\s+tháng") | reduce(lambda a, k: a | x.rlike(rf"(?iu)(?:^|\s){_spaced(k)}(?=\s|$|[:.–—-])"), TYPES, F.lit(False)))
    stop = F.array_position(structural, True).cast("int")
    candidates = F.slice(F.split("header", "\n"), F.lit(1), F.when(stop > 0, stop).otherwise(F.least(F.size(F.split("header", "\n")), F.lit(8))))
    candidates = F.filter(F.transform(candidates, lambda x: _undecorated(F.get(F.split(x, r"(?iu)CỘNG\s+HÒA"), F.lit(0)))), lambda x: (x != "") & ~x.rlike(LABEL))
    area = F.concat(F.array_join(candidates, "\n"), F.lit("\n"), F.regexp_replace(F.get(F.split("header", r"(?iu)CỘNG\s+HÒA"), F.lit(0)), LABEL, " "))
    rows = rows.withColumn("area", T.once(area)).withColumn("candidates", candidates)
    known = F.coalesce(*[F.when(F.col("area").rlike(f"(?iu){a}"), a) for a in AUTHORITIES])
    loud = lambda x: F.regexp_count(x, F.lit(r"\p{Lu}")) / F.regexp_count(x, F.lit(r"\p{L}")) > 0.82
    generic = F.filter("candidates", lambda x: F.length(x).between(3, 90) & ~x.rlike(r"(?iu)CỘNG HÒA|Độc lập|Số\s*:|,\s*ngày\s+|Căn cứ") & (F.regexp_count(x, F.lit(r"\p{L}")) > 0) & F.coalesce(loud(x), F.lit(False)))
    inferred = F.coalesce(*[F.when(F.col("upper").rlike(p), a) for p, a in AUTHORITY_OF_NUMBER], F.lit(NO_AUTHORITY))
    rows = rows.withColumn("authority", F.coalesce(known, F.get(generic, F.lit(0)), inferred))
    # title: what the type leaves behind it, or what all other fields leave
    quoted = lambda c: F.regexp_replace(F.regexp_replace(c, r"([.*+?^${}()|\[\]\\/-])", r"\\$1"), r"\s+", r"\\s+")
    free = F.col("clean")
    for field in (F.col("authority"), F.lit(NATION), F.lit(MOTTO), F.col("dateline")):
        free = F.when(field.isNull(), free).otherwise(F.regexp_replace(free, F.concat(F.lit("(?iu)"), quoted(F.coalesce(field, F.lit("\x00")))), F.lit(" ")))
    behind = F.substring("clean", F.col("type_at") + F.length("type") + 1, F.length("clean"))
    title = F.when(F.col("type_at").isNotNull(), behind).otherwise(free)
    for pattern in (LABEL, f"(?u){_spaced(NATION)}", r"(?u)Độc\s+lập\s*-\s*Tự\s+do\s*-\s*Hạnh\s+phúc", NUMBER, DATE_SPAN):
        title = F.regexp_replace(title, pattern, " ")
    title = _undecorated(title)
    grounds = F.split(F.regexp_replace(F.regexp_replace("body", rf"(?iu);\s*(?={GROUNDS})", ";\x01"), rf"(?iu)\s+(?={GROUNDS})", "\x01"), "\x01")
    grounds = F.filter(F.transform(grounds, lambda g: F.trim(F.regexp_replace(g, r"\s+", " "))), lambda g: g != "")
    return rows.select(
        F.col("key").alias(key), "authority", F.lit(NATION).alias("nation"), F.lit(MOTTO).alias("motto"), F.when(F.col("number").isNotNull(), F.concat(F.lit("Số: "), "number")).alias("number"), "dateline", "type",
        F.when((title != "") & (F.upper(title) != F.col("type")), title).alias("title"), grounds.alias("grounds"),
    )


def preamble_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, place, kind, text``: a preamble's fields as blocks in their order, then its grounds."""
    rows = preamble(docs, key, text)
    kinds = ["authority", "nation", "motto", "number", "dateline", "type", "title"]
    block = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    fields = F.filter(F.array(*[block(f"preamble-{k}", F.col(k)) for k in kinds]), lambda b: b["text"].isNotNull())
    every = F.concat(fields, F.transform("grounds", lambda g: block("paragraph", g)))
    return rows.select(key, F.posexplode(every).alias("place", "b")).select(key, (F.col("place") + 1).alias("place"), "b.kind", "b.text")
