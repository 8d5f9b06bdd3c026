"""Layout and evidence queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import duck as D
from quillon.operators import layout as L
from quillon.operators import sheets as S
from quillon.operators import tables as B
from quillon.plans.retrieval import table
from quillon.plans.sheets import order_sheets

CATEGORIES = [("numbers", r"\d+"), ("table", r"\|"), ("licence", r"[Ll]icen[cs]e"), ("english", r"(?:^|\s)the\s"), ("french", r"(?:^|\s)(?:les|une)\s")]
SHEET = [["BÁO CÁO", "", ""], ["", "", ""], ["STT", "Ngày lập", "Tổng tiền"], ["1", "01/02/2026", "1000"], ["2", "02/02/2026", "2000"], ["3", "03/02/2026", "3000"]]
GROUPED = [["Người bán", "Người bán", "Hóa đơn"], ["MST", "Tên", "Số hóa đơn"], ["0100", "Công ty A", "17"], ["0101", "Công ty B", "18"], ["0102", "Công ty C", "19"]]


def cases(spark: SparkSession) -> DataFrame:
    """Layouts of two small sheets, for the tests."""
    rows = [(name, r, c, v) for name, sheet in (("report", SHEET), ("grouped", GROUPED)) for r, row in enumerate(sheet) for c, v in enumerate(row)]
    cells = spark.createDataFrame(rows, "sheet STRING, row INT, col INT, value STRING")
    return L.sheet_layouts(cells, B.value_kind(F.col("value")))


def sheet_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where header and data lie in each customer's sheet of orders, under whose merged titles and headers cells are empty."""
    cells, merges = order_sheets(table(spark, sf_dir, "orders"))
    return L.row_layouts(S.shown_rows(cells, merges), lambda c: B.value_kind(c["value"])).drop("confidence")


def evidence_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = L.evidence_sentences(table(spark, sf_dir, "documents"), "doc_id", "text", CATEGORIES)
    return L.spread_over_categories(points, "doc_id", 4).select("doc_id", "nth", "category", "importance", "in_category", "place", F.md5("sentence").alias("sentence_md5"))


def points_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points each source has in each category, with subtotals."""
    docs = table(spark, sf_dir, "documents")
    points = L.evidence_sentences(docs, "doc_id", "text", CATEGORIES)
    return docs.select("doc_id", "source").join(points, "doc_id").rollup("source", "category").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (sheet_layouts, evidence_points, points_by_category)}

_Q = D.quote
_PARTS = f"list_filter(list_transform(string_split(regexp_replace({D.squeeze('text')}, {_Q(L.SENTENCE)}, '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) BETWEEN 35 AND 420)[1:6]"
_POINTS = f"""
a AS (SELECT doc_id, source, {_PARTS} AS l FROM documents), b AS (SELECT doc_id, source, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS nth FROM a),
p AS (SELECT *, CASE {' '.join(f'WHEN regexp_matches(sentence, {_Q(x)}) THEN {_Q(n)}' for n, x in CATEGORIES)} ELSE 'overview' END AS category, CASE WHEN nth < 2 THEN 4 ELSE 3 END AS importance FROM b)"""
ORACLE = {
    "sheet_layouts": "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS sheet, 1 AS header_start, 2 AS header_end, 3 AS data_start FROM orders WHERE o_custkey IS NOT NULL",
    "evidence_points": f"""
WITH {_POINTS}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY importance DESC, nth) AS in_category FROM p),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (in_category > 1)::INTEGER, importance DESC, nth) AS place FROM c)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, category, importance, CAST(in_category AS INTEGER) AS in_category, CAST(place AS INTEGER) AS place, md5(sentence) AS sentence_md5 FROM d WHERE place <= 4""",
    "points_by_category": f"WITH {_POINTS} SELECT source, category, count(*) AS n FROM p GROUP BY ROLLUP (source, category)",
}
