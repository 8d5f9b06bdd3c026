"""Parts and preambles of texts that are made of all documents, so that SQL can say from the documents what has to come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import presentation as P
from quillon.plans.retrieval import table
from quillon.sources.shared import shared_folder

SIGNATURE, RECEIVERS, APPENDIX = "KT. BỘ TRƯỞNG\nTHỨ TRƯỞNG", "Nơi nhận:\n- Như trên", "PHỤ LỤC I\nBiểu mẫu"
#: Types, number suffixes and authorities of preambles, by the document's id.
KINDS = [("NGHỊ ĐỊNH", "NĐ-CP", "CHÍNH PHỦ"), ("THÔNG TƯ", "TT-BTC", "BỘ TÀI CHÍNH"), ("QUYẾT ĐỊNH", "QĐ-TTg", "THỦ TƯỚNG CHÍNH PHỦ")]


def _lines(text: Column) -> Column:
    """Lines of a document that can't be mistaken for anything."""
    plain = F.transform(F.split(T.tidy(F.coalesce(text, F.lit(""))), "\n"), lambda x: T.squeeze(F.regexp_replace(F.lower(x), r"[*#_]", " ")))
    return F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.concat(F.lit("nội dung "), x))


def articles_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the first line as preamble, each line behind it as an article or its second line, then signature, receivers and an appendix, as the id says."""
    rows = docs.select("doc_id", T.once(_lines(F.col("text"))).alias("l")).where("size(l) >= 2")
    k = F.col("doc_id")
    body = F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x, i: F.when(i % 3 == 2, x).otherwise(F.concat(F.lit("Điều "), (i + 1).cast("string"), F.lit(". Tên của điều "), (i + 1).cast("string"), F.lit("\n"), x))), "\n")
    tail = F.when(k % 3 == 0, F.lit("./. " + SIGNATURE)).when(k % 3 == 1, F.lit("\n" + RECEIVERS)).otherwise("")
    more = F.when(k % 5 < 2, F.lit("\n" + APPENDIX)).otherwise("")
    return rows.select("doc_id", F.concat(F.lit("BỘ TÀI CHÍNH\n"), F.get("l", F.lit(0)), F.lit("\n"), body, tail, more).alias("text"))


def presented_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all documents, cut again."""
    parts = P.parts(articles_of(table(spark, sf_dir, "documents")), "doc_id", "text")
    return parts.select("doc_id", "order_index", "kind", "identifier", "heading", F.md5("text").alias("text_md5"))


#: Lines of a page, and the first page of every third document.
LINES, LATER = 5, 7


def provisions_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all documents out of pages of five lines; every third document lacks its first pages."""
    texts = articles_of(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    first = F.when(F.col("doc_id") % 3 == 0, LATER).otherwise(1)
    pages = texts.withColumn("page", (F.floor(F.col("at") / LINES) + first).cast("int")).groupBy("doc_id", "page")
    pages = pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    found = P.main_provisions(pages, "doc_id", "page", "text")
    return found.select("doc_id", "first_page", "order_index", "kind", "identifier", "heading", F.md5("text").alias("text_md5"))


def reader_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of all documents, each line of which is an article with a table and a paragraph."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.once(_lines(F.col("text"))).alias("l")).where("size(l) >= 1")

    def article(x: Column, i: Column) -> Column:
        n, cell = (i + 1).cast("string"), F.regexp_replace(x, r"\|", " ")
        return F.concat(F.lit("Điều "), n, F.lit(". Tên của điều "), n, F.lit("\n| STT | Nội dung | Ghi chú |\n| 1 | "), cell, F.lit(" | có |\n| 2 | không | |\nđoạn văn "), n, F.lit(" kết thúc."))

    texts = docs.select("doc_id", F.array_join(F.transform("l", article), "\n").alias("text"))
    items = P.reader_items(texts, "doc_id", "text", shared_folder(spark, "reader"))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return items.select("doc_id", "order_index", "identifier", "heading", "place", "kind", F.md5(F.coalesce(cells, F.col("text"))).alias("said_md5"))


def preambles_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a preamble for each document, whose fields stand in lines or run together, and whose type may be missing."""
    k = F.col("doc_id")
    of = lambda part: F.get(F.array(*[F.lit(x[part]) for x in KINDS]), (k % 3).cast("int"))
    first = F.get(_lines(F.col("text")), F.lit(0))
    number = F.concat(F.lit("Số: "), (1 + k % 900).cast("string"), F.when(k % 2 == 0, F.lit("/2026/")).otherwise(F.lit(" / 2026 / ")), of(1))
    nation, dated = F.lit(f"{P.NATION}{{}}{P.MOTTO}"), F.concat(F.lit("Hà Nội, ngày 0"), (1 + k % 9).cast("string"), F.lit(" tháng "), (1 + k % 12).cast("string"), F.lit(" năm 2026"))
    gap = F.when(k % 4 < 2, F.lit("\n")).otherwise(F.lit(" "))
    head = F.concat(of(2), F.lit("\n"), F.replace(nation, F.lit("{}"), gap), F.lit("\n"), number, F.lit("\n"), dated, F.lit("\n"))
    kind = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(of(0), gap))
    return docs.where(first.isNotNull()).select("doc_id", F.concat(head, kind, first, F.lit("\nCăn cứ Luật số "), k.cast("string"), F.when(k % 2 == 0, "; Theo đề nghị của Bộ trưởng;").otherwise(";")).alias("text"))


def preamble_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a preamble for each document, found again."""
    rows = P.preamble(preambles_of(table(spark, sf_dir, "documents")), "doc_id", "text")
    return rows.select("doc_id", "authority", "number", "dateline", "type", F.md5("title").alias("title_md5"), F.array_join("grounds", "|").alias("grounds"))


QUERIES = {f.__name__: f for f in (presented_parts, provisions_of_pages, reader_items, preamble_fields)}

_Q = D.quote
_PLAIN = D.squeeze("regexp_replace(lower(x), '[*#_]', ' ', 'g')")
_L = f"list_transform(list_filter(list_transform(string_split({D.tidy(chr(99) + 'oalesce(text, ' + _Q('') + ')')}, chr(10)), lambda x: {_PLAIN}), lambda x: x <> ''), lambda x: 'nội dung ' || x)"
_OF = lambda part: f"CASE doc_id % 3 {' '.join(f'WHEN {n} THEN {_Q(x[part])}' for n, x in enumerate(KINDS))} END"

ORACLE = {
    "presented_parts": f"""
WITH d AS (SELECT doc_id, {_L} AS l FROM documents), m AS (SELECT * FROM d WHERE len(l) >= 2),
e AS (SELECT doc_id, len(l) - 1 AS n, unnest(l[2:]) AS x, generate_subscripts(l[2:], 1) AS i FROM m),
a AS (SELECT doc_id, n, (i - 1) // 3 * 3 + CASE WHEN (i - 1) % 3 = 0 THEN 1 ELSE 2 END AS article, i, x || CASE WHEN i = n AND doc_id % 3 = 0 THEN './.' ELSE '' END AS x FROM e),
g AS (SELECT doc_id, article, string_agg(x, chr(10) ORDER BY i) AS body FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY article) AS nth, count(*) OVER (PARTITION BY doc_id) AS every FROM g)
SELECT doc_id, CAST(nth * 100 AS INTEGER) AS order_index, 'article' AS kind, 'Điều ' || article AS identifier, 'Tên của điều ' || article AS heading, md5(body) AS text_md5 FROM r
UNION ALL SELECT doc_id, 0, 'preamble', {_Q(P.OPENING)}, NULL, md5('BỘ TÀI CHÍNH' || chr(10) || l[1]) FROM m
UNION ALL SELECT doc_id, CAST((every + 1) * 100 AS INTEGER), 'other', {_Q(P.SIGNED)}, NULL, md5(CASE WHEN doc_id % 3 = 0 THEN {_Q(SIGNATURE)} ELSE {_Q(RECEIVERS)} END) FROM r WHERE nth = 1 AND doc_id % 3 < 2
UNION ALL SELECT doc_id, CAST((every + 2) * 100 AS INTEGER), 'other', {_Q(P.APPENDED)}, NULL, md5({_Q(APPENDIX)}) FROM r WHERE nth = 1 AND doc_id % 5 < 2""",
    "preamble_fields": f"""
WITH d AS (SELECT doc_id, {_L} AS l FROM documents)
SELECT doc_id, {_OF(2)} AS authority, 'Số: ' || (1 + doc_id % 900) || '/2026/' || {_OF(1)} AS number, 'Hà Nội, ngày ' || (1 + doc_id % 9) || ' tháng ' || (1 + doc_id % 12) || ' năm 2026' AS dateline, {_OF(0)} AS type,
  md5(l[1]) AS title_md5, 'Căn cứ Luật số ' || doc_id || ';' || CASE WHEN doc_id % 2 = 0 THEN '|Theo đề nghị của Bộ trưởng;' ELSE '' END AS grounds
FROM d WHERE len(l) >= 1""",
}
ORACLE["provisions_of_pages"] = f"""
WITH p AS ({ORACLE['presented_parts']})
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {LATER} ELSE 1 END AS first_page, order_index, CASE WHEN kind = 'preamble' AND doc_id % 3 = 0 THEN 'continuation' ELSE kind END AS kind,
  CASE WHEN kind = 'preamble' AND doc_id % 3 = 0 THEN '{P.CONTINUED}{LATER}' ELSE identifier END AS identifier, heading, text_md5 FROM p"""
ORACLE["reader_items"] = f"""
WITH d AS (SELECT doc_id, {_L} AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM d),
c AS (SELECT doc_id, n, {D.squeeze("replace(x, '|', ' ')")} AS cell FROM e)
SELECT doc_id, CAST(n * 100 AS INTEGER) AS order_index, 'Điều ' || n AS identifier, 'Tên của điều ' || n AS heading, p AS place, CASE p WHEN 1 THEN 'table' ELSE 'paragraph' END AS kind,
  md5(CASE p WHEN 1 THEN 'STT|Nội dung|Ghi chú' || chr(10) || '1|' || cell || '|có' || chr(10) || '2|không|' ELSE 'đoạn văn ' || n || ' kết thúc.' END) AS said_md5
FROM c, (SELECT unnest([1, 2])::INTEGER AS p)"""
