"""Sheets with merged cells that are made of all orders, and what has to be found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import formulas as X
from quillon.operators import sheets as S
from quillon.operators import speech as A
from quillon.plans.retrieval import table
from quillon.sources.shared import shared_folder
from quillon.sources.spreadsheets import Workbooks

#: The header rows of each sheet; equal neighbours in the first one are a merged cell. The last column only continues the one before.
TOP, BELOW = ["Đơn hàng", "Đơn hàng", "Giá trị", "Giá trị", "Giá trị"], ["Số đơn", "Ngày lập", "Tổng tiền", "Ghi chú", "Ghi chú"]


def order_sheets(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and merged rectangles: a sheet for each customer with a title over all columns, two header rows, and three rows for each order, whose last two columns are one cell."""
    rows = orders.where("o_custkey IS NOT NULL").select(F.col("o_custkey").alias("sheet"), "o_orderkey", "o_totalprice", "o_orderpriority", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    rows = rows.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("row", F.col("n") * 3 + F.col("part"))
    values = F.array(
        (F.col("o_orderkey") * 3 + F.col("part")).cast("string"), F.concat(F.lpad((1 + F.col("o_orderkey") % 28).cast("string"), 2, "0"), F.lit("/02/2026")), F.floor("o_totalprice").cast("string"), F.col("o_orderpriority"))
    data = rows.select("sheet", "row", F.posexplode(values).alias("col", "value"))
    sheets = rows.select("sheet").distinct()
    heads = [(0, 0, None), *((1, c, x) for c, x in enumerate(TOP) if c == 0 or TOP[c - 1] != x), *((2, c, x) for c, x in enumerate(BELOW) if c == 0 or BELOW[c - 1] != x)]
    head = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), (F.concat(F.lit("Khách hàng "), F.col("sheet").cast("string")) if x is None else F.lit(x)).alias("value")) for r, c, x in heads])
    cells = data.unionByName(sheets.select("sheet", F.inline(head)))
    fixed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("r1", "c1", "r2", "c2"), box, strict=True)]) for box in ((0, 0, 0, 4), (1, 0, 1, 1), (1, 2, 1, 4), (2, 3, 2, 4))])
    each = rows.select("sheet", F.col("row").alias("r1"), F.lit(3).alias("c1"), F.col("row").alias("r2"), F.lit(4).alias("c2"))
    return cells, each.unionByName(sheets.select("sheet", F.inline(fixed)))


def merged_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, columns, titles and data of each customer's sheet."""
    found = S.analysis(*order_sheets(table(spark, sf_dir, "orders")), shared_folder(spark, "sheets"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    return found.select("sheet", "header_start", "header_end", "data_start", "data_end", joined("columns").alias("columns"), joined("headers").alias("headers"), joined("preamble").alias("preamble"))


def exported_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, written as workbooks and read back cell by cell."""
    spark.dataSource.register(Workbooks)
    orders = table(spark, sf_dir, "orders")
    folder = shared_folder(spark, "workbooks")
    orders.write.format("workbook").mode("append").save(folder)
    cells = spark.read.format("workbook").load(folder).where("row > 0")
    rows = cells.groupBy("file", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cells"))
    return rows.select(*[F.element_at("cells", F.lit(n)).cast(kind).alias(c) for n, (c, kind) in enumerate(orders.dtypes)])


#: Sheets that the target workbook has, and those of each imported one, in order.
TAKEN, SHEETS = ["Sheet1", "Dữ liệu"], ["Sheet1", "Dữ liệu", "sheet1 (2)", "It's", "x" * 40]


def imported_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's workbook, with a formula for each order, imported into one that has some of its sheets' names; the formulas stand two rows further down."""
    orders = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL")
    rows = orders.select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") % len(SHEETS)).cast("int").alias("at"), F.col("o_orderkey").alias("row"))
    n = F.col("row").cast("string")
    formula = F.concat(F.lit("SUM(Sheet1!A"), n, F.lit(":$B$2)+'Dữ liệu'!C$1*'It''s'!D"), n, F.lit("+LOG10(E"), n, F.lit(')&"Sheet1!A1 ""F'), n, F.lit(3 * '"' + "&x!G1"))
    cells = rows.select("book", F.get(F.array(*map(F.lit, SHEETS)), F.col("at")).alias("sheet"), "row", F.lit(0).alias("col"), formula.alias("formula"))
    books = rows.select("book").distinct().select("book", F.posexplode(F.array(*map(F.lit, SHEETS))).alias("position", "sheet"))
    out = X.imported(books, cells, F.array(*map(F.lit, TAKEN)))
    return out.select("book", "row", "new_sheet", X.moved(F.col("formula"), F.lit(2)).alias("formula"))


#: The header of a table of orders that is read aloud.
READ = ["STT", "Nội dung", "Đạt", "Không đạt"]


def _read_rows(orders: DataFrame) -> DataFrame:
    """``doc, n, cells``: a header, a row of column numbers and each customer's orders."""
    rows = orders.where("o_custkey IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    done = F.col("o_orderstatus") == "F"
    boxes = [F.when(done, "☑").otherwise("□"), F.when(done, "□").otherwise(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("☑"))]
    data = rows.select(F.col("o_custkey").alias("doc"), "n", "o_orderkey", F.array(F.col("n").cast("string"), F.concat(F.lit("đơn hàng "), F.col("o_orderkey").cast("string")), *boxes).alias("cells"))
    top = [(-1, READ), (0, [f"({n})" for n in range(1, 5)])]
    heads = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(None).cast("bigint").alias("o_orderkey"), F.array(*map(F.lit, cells)).alias("cells")) for n, cells in top])
    return data.unionByName(rows.select(F.col("o_custkey").alias("doc")).distinct().select("doc", F.inline(heads)))


def spoken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said for each order's row, for listening and for checking."""
    rows = _read_rows(table(spark, sf_dir, "orders")).where("n > 0")
    header = F.array(*map(F.lit, READ))
    return rows.select("o_orderkey", A.told_row(header, F.col("cells")).alias("told"), A.checked_row(header, F.col("cells")).alias("checked"))


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows head each customer's table."""
    return A.header_counts(_read_rows(table(spark, sf_dir, "orders")), "doc", "n", "cells")


QUERIES = {f.__name__: f for f in (merged_sheets, exported_orders, imported_formulas, spoken_rows, header_rows)}

ORACLE = {
    "merged_sheets": """
SELECT CAST(o_custkey AS VARCHAR) AS sheet, 1 AS header_start, 2 AS header_end, 3 AS data_start, CAST(count(*) * 3 + 2 AS INTEGER) AS data_end, '0|1|2|3' AS columns,
  'Đơn hàng · Số đơn|Đơn hàng · Ngày lập|Giá trị · Tổng tiền|Giá trị · Ghi chú' AS headers, 'Khách hàng ' || o_custkey AS preamble
FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey""",
    "exported_orders": "SELECT * FROM orders",
    "header_rows": "SELECT DISTINCT o_custkey AS doc, 2 AS header_rows FROM orders WHERE o_custkey IS NOT NULL",
    "spoken_rows": """
SELECT o_orderkey, 'Mục ' || n || '. đơn hàng ' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '. Đã chọn Đạt' WHEN o_orderkey % 3 <> 0 THEN '. Đã chọn Không đạt' ELSE '' END || '.' AS told,
  'STT: ' || n || '. Nội dung: đơn hàng ' || o_orderkey || '. Đạt: ' || CASE WHEN o_orderstatus = 'F' THEN 'đã' ELSE 'chưa' END || ' đánh dấu. Không đạt: ' || CASE WHEN o_orderstatus = 'F' THEN 'chưa đánh dấu' WHEN o_orderkey % 3 = 0 THEN 'để trống' ELSE 'đã đánh dấu' END || '.' AS checked
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey IS NOT NULL)""",
    "imported_formulas": """
SELECT o_custkey AS book, o_orderkey AS row, CASE o_orderkey % 5 WHEN 0 THEN 'Sheet1 (2)' WHEN 1 THEN 'Dữ liệu (2)' WHEN 2 THEN 'sheet1 (2) (2)' WHEN 3 THEN 'It''s' ELSE repeat('x', 31) END AS new_sheet,
  'SUM(''Sheet1 (2)''!A' || (o_orderkey + 2) || ':$B$2)+''Dữ liệu (2)''!C$1*''It''''s''!D' || (o_orderkey + 2) || '+LOG10(E' || (o_orderkey + 2) || ')&"Sheet1!A1 ""F' || o_orderkey || repeat(chr(34), 3) || '&x!G3' AS formula
FROM orders WHERE o_custkey IS NOT NULL""",
}
