"""Blocks and tables of pages that are made of given tables, so that SQL can say from these tables what has to come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.functions import text as T
from quillon.operators import blocks as B
from quillon.operators import stitching as S
from quillon.plans.retrieval import table
from quillon.sources.shared import shared_folder

#: Rows of a page; how a page begins that goes on with the last row of the page before.
ROWS_A_PAGE, REST = 4, "và phần còn lại của hàng trước"
HEADER = "| STT | Nội dung | Đạt | Không đạt |"


def _plain(line: Column) -> Column:
    """A line of a document without pipes."""
    return T.squeeze(F.regexp_replace(line, r"\|", " "))


def decorated(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: each line of a document in one of eight forms, by its place."""
    lines = F.filter(F.transform(F.split(T.tidy(F.coalesce("text", F.lit(""))), "\n"), _plain), lambda x: x != "")
    said = lambda x: F.concat(F.lit("nội dung "), F.lower(x))

    def form(x: Column, i: Column) -> Column:
        nth, kind = (i + 1).cast("string"), F.pmod(F.col("doc_id") + i, F.lit(8))
        return (
            F.when(kind == 0, F.concat(F.lit("Điều "), nth, F.lit(". "), x)).when(kind == 1, F.concat(F.lit("☑ "), x)).when(kind == 2, F.concat(F.lit("□ "), said(x))).when(kind == 3, F.concat(F.lit("Ghi chú: "), x))
            .when(kind == 4, F.concat(F.lit(f"{HEADER}\n| :--- | :--- | :--- | :--- |\n| "), nth, F.lit(" | "), said(x), F.lit(" □ ☑ |"))).when(kind == 5, F.concat(F.lit("Họ tên người khai "), nth, F.lit(": ..........")))
            .when(kind == 6, F.concat(F.lit("b) "), said(x))).otherwise(F.concat(said(x), F.lit(" cho\nvà hết."))))

    return docs.select("doc_id", F.array_join(F.transform(lines, form), "\n").alias("text"))


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents, whose lines take turns as articles, boxes, notes, tables, fields, lists and paragraphs."""
    blocks = B.build_blocks(decorated(table(spark, sf_dir, "documents")), "doc_id", "text", shared_folder(spark, "blocks"))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    said = F.concat_ws("#", F.col("text"), F.col("mark"), F.col("value"), F.col("checked").cast("string"), cells, "first_column", F.col("header_rows").cast("string"))
    return blocks.select("doc_id", "place", "kind", F.md5(said).alias("said_md5"))


def order_pages(orders: DataFrame) -> DataFrame:
    """``doc, page, text``: the orders of each customer as a table over pages. Some pages repeat the header, some rows are cut at the end of a page, some go on in front of the next one's table."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = orders.where("o_custkey IS NOT NULL").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.row_number().over(order).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("all"))
    pages = F.greatest(F.lit(1), F.floor(F.col("all") / ROWS_A_PAGE))
    rows = rows.withColumn("page", F.least(F.floor((F.col("n") - 1) / ROWS_A_PAGE) + 1, pages).cast("int")).withColumn("pages", pages)
    again = lambda page: F.pmod(F.col("o_custkey") + page, F.lit(5)) == 0
    ends = (F.col("n") == F.col("page") * ROWS_A_PAGE) & (F.col("page") < F.col("pages"))
    rows = rows.withColumn("cut", ends & (F.col("o_custkey") % 3 == 0) & ~again(F.col("page") + 1))
    head, tail = F.concat(F.lit("đơn hàng "), F.col("o_orderkey").cast("string")), F.regexp_replace(F.lower(F.concat(F.lit("loại "), F.col("o_orderpriority"))), r"[^\p{L}\p{N}]+", " ")
    boxes = F.when(F.col("o_orderstatus") == "F", "☑ | □").otherwise("□ | ☑")
    number = F.concat(F.lit("| "), F.col("n").cast("string"), F.lit(" | "))
    whole = F.concat(number, head, F.lit(" "), tail, F.lit(" | "), boxes, F.lit(" |"))
    first, second = F.concat(number, head, F.lit(" |")), F.concat(number, tail, F.lit(" | "), boxes, F.lit(" |"))
    here = rows.select("o_custkey", "page", "n", F.when(F.col("cut"), first).otherwise(whole).alias("line"))
    there = rows.where("cut").select("o_custkey", (F.col("page") + 1).alias("page"), "n", second.alias("line"))
    heads = rows.select("o_custkey", "page").distinct().where((F.col("page") == 1) | again(F.col("page"))).select("o_custkey", "page", F.lit(-1).alias("n"), F.lit(f"{HEADER}\n| --- | --- | --- | --- |").alias("line"))
    rests = rows.where(ends & ~F.col("cut") & (F.col("o_custkey") % 4 == 0)).select("o_custkey", (F.col("page") + 1).alias("page"), F.lit(-2).alias("n"), F.lit(REST).alias("line"))
    lines = here.unionByName(there).unionByName(heads).unionByName(rests).groupBy(F.col("o_custkey").alias("doc"), "page")
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def stitched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of each customer's orders, whole again."""
    blocks = S.page_blocks(order_pages(table(spark, sf_dir, "orders")), "doc", "page", "text", shared_folder(spark, "pages"))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return S.stitched_tables(blocks).select("doc", "table", "first_page", "last_page", "parts", "header_rows", "columns", F.md5(cells).alias("rows_md5"), "cut_rows", "unclear_rows")


QUERIES = {f.__name__: f for f in (document_blocks, stitched_orders)}

_SAID = "'nội dung ' || lower(x)"
_KIND = lambda cases: "CASE k " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(cases)) + " END"
_NO = "NULL"

ORACLE = {
    "document_blocks": f"""
WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split({D.tidy("coalesce(text, '')")}, chr(10)), lambda x: {D.squeeze("replace(x, '|', ' ')")}), lambda x: x <> '') AS l FROM documents),
each AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM lines),
kinds AS (SELECT *, (doc_id + n - 1) % 8 AS k FROM each)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS place, {_KIND(["'article'", "'checkbox'", "'checkbox'", "'note'", "'table'", "'field'", "'list'", "'paragraph'"])} AS kind,
  md5({_KIND([
      "'Điều ' || n || '. ' || x", "x || '#true'", f"{_SAID} || '#false'", "'Ghi chú: ' || x", f"'STT|Nội dung|Đạt|Không đạt' || chr(10) || n || '|' || trim(regexp_replace({_SAID}, '(?:\\s*(?:□|☐|☑|✓|✔)){{2,}}\\s*$', '')) || '|□|☑#index#1'",
      "'#Họ tên người khai ' || n || ':#'", f"{_SAID} || '#b)'", f"{_SAID} || ' cho và hết.'"])}) AS said_md5
FROM kinds""",
    "stitched_orders": f"""
WITH rows AS (
  SELECT o_custkey AS doc, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS every FROM orders WHERE o_custkey IS NOT NULL
), paged AS (
  SELECT *, greatest(1, every // {ROWS_A_PAGE}) AS pages, least((n - 1) // {ROWS_A_PAGE} + 1, greatest(1, every // {ROWS_A_PAGE})) AS page FROM rows
), ends AS (
  SELECT *, n = page * {ROWS_A_PAGE} AND page < pages AS last FROM paged
), marked AS (SELECT *, last AND doc % 3 = 0 AND (doc + page + 1) % 5 <> 0 AS cut FROM ends)
SELECT doc, 1 AS "table", 1 AS first_page, max(page) AS last_page, max(page) AS parts, 1 AS header_rows, 4 AS columns,
  md5('STT|Nội dung|Đạt|Không đạt' || chr(10) || string_agg(n || '|đơn hàng ' || o_orderkey || ' ' || regexp_replace(lower('loại ' || o_orderpriority), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')
    || CASE WHEN last AND NOT cut AND doc % 4 = 0 THEN ' {REST}' ELSE '' END || CASE WHEN o_orderstatus = 'F' THEN '|☑|□' ELSE '|□|☑' END, chr(10) ORDER BY n)) AS rows_md5,
  count(*) FILTER (WHERE cut) AS cut_rows, 0 AS unclear_rows
FROM marked GROUP BY doc""",
}
