"""Readers: delimited files with caps, JSON payloads of gazettes, format routing and text of DOCX files."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

PAYLOAD = "data ARRAY<STRUCT<so_ky_hieu: STRING, trich_yeu: STRING, ngay_ban_hanh: STRING, danh_sach_tep_van_ban: ARRAY<STRUCT<file_name: STRING, duong_dan: STRING>>>>"


def format_of(name: Column, mime: Column) -> Column:
    """Format by media type, then by extension, first match."""
    n, m = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(m.contains("wordprocessingml") | n.endswith(".docx"), "docx").when(m.contains("msword") | n.endswith(".doc"), "doc").when(m.contains("pdf") | n.endswith(".pdf"), "pdf")
        .when(m.contains("html") | n.rlike(r"\.html?$"), "html").when(m.contains("spreadsheet") | n.rlike(r"\.(?:xlsx|xlsm|xls|ods)$"), "sheet").when(n.rlike(r"\.(?:csv|tsv)$"), "delimited").otherwise("plain")
    )


def delimited(spark: SparkSession, path: str, separator: str = ",", rows: int = 50_000, columns: int = 500) -> DataFrame:
    """Cells ``file, row, col, value, truncated`` of delimited files, quotes and quoted line ends respected.

    Every row has as many cells as the file's widest, empty ones where its line is shorter. The caps on rows and columns of a
    file are part of the format's contract; ``truncated`` says whether they cut the file.
    """
    schema = ", ".join(f"c{n} STRING" for n in range(columns + 1))  # one more column shows that there are more
    read = spark.read.schema(schema).options(sep=separator, multiLine=True, quote='"', escape='"', emptyValue="", mode="PERMISSIVE").csv(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.array(*read.columns).alias("cells"))
    # a file with quoted line ends isn't split, so its rows are numbered without a gap
    width = F.array_max(F.transform("cells", lambda c, n: F.when(c.isNotNull(), n + 1)))
    files = lines.groupBy("file").agg(F.min("at").alias("first"), F.least(F.lit(columns), F.coalesce(F.max(width), F.lit(0))).alias("width"), (F.count(F.lit(1)) > rows).alias("long"), F.max(F.get("cells", F.lit(columns)).isNotNull()).alias("wide"))
    numbered = lines.join(files, "file").withColumn("row", (F.col("at") - F.col("first") + 1).cast("int")).where(F.col("row") <= rows)
    cells = numbered.select("file", "row", F.posexplode(F.slice("cells", F.lit(1), F.col("width"))).alias("col", "value"), (F.col("long") | F.col("wide")).alias("truncated"))
    return cells.withColumn("value", F.coalesce("value", F.lit("")))


def gazette_attachments(payloads: DataFrame, number: str, payload: str) -> DataFrame:
    """Attachments of exactly the wanted document in JSON payloads: docx before doc before pdf before others, each URL once."""
    docs = payloads.select(F.col(number).alias("wanted"), F.explode(F.from_json(payload, PAYLOAD)["data"]).alias("d"))
    compact = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    docs = docs.where(compact(F.col("d.so_ky_hieu")) == compact(F.col("wanted")))
    files = docs.select("wanted", F.col("d.trich_yeu").alias("title"), F.posexplode("d.danh_sach_tep_van_ban").alias("at", "f")).select("wanted", "title", "at", F.col("f.duong_dan").alias("url"), F.lower(F.coalesce("f.file_name", "f.duong_dan")).alias("name"))
    priority = F.when(F.col("name").rlike(r"\.docx$"), 0).when(F.col("name").rlike(r"\.doc$"), 1).when(F.col("name").rlike(r"\.pdf$"), 2).otherwise(3)
    one = files.withColumn("priority", priority).groupBy("wanted", "url").agg(F.min(F.struct("priority", "at")).alias("best"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("wanted").orderBy("best"))).select("wanted", "url", F.col("best.priority").alias("priority"), "rank")


@pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Text of DOCX files (bytes): paragraphs as lines; null if it isn't one."""

    def one(data: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                names = {n.replace("\\", "/"): n for n in z.namelist()}
                xml = z.read(names["word/document.xml"]).decode()
        except (zipfile.BadZipFile, KeyError, UnicodeDecodeError):
            return None
        from xml.sax.saxutils import unescape

        parts = re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>|(</w:p>|<w:br\b[^>]*>)|(<w:tab\b[^>]*>)", xml)
        return unescape("".join(t or ("\n" if end else "\t") for t, end, _ in parts), {"&quot;": '"', "&apos;": "'"}).strip()

    return content.map(one)
