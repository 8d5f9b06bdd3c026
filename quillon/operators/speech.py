"""Tables read aloud: which rows head them, and what is said for a row.

Null cells are empty. Rows of different lengths are filled up. Tables without rows say nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.segments import _let as let
from quillon.operators.publishing import SPEECH_RULES, strip

#: Check boxes, headers of running numbers and of contents, and what is said of cells.
TICKED, OPEN_BOX, BOX = "(?:☑|✓|✔)", "(?:□|☐)", "(?:□|☐|☑|✓|✔)"
INDEX, CONTENT = r"(?iu)^(?:stt|số thứ tự)$", r"(?iu)nội dung|tiêu chí|họ và tên|tên mẫu"
IS_TICKED, IS_OPEN, EMPTY = "đã đánh dấu", "chưa đánh dấu", "để trống"
#: Words of header rows below the first one, and numbers; header rows that are looked at.
HEADER_HINT = r"(?iu)(?<![\p{L}\d])(?:stt|số\s+thứ\s+tự|nhóm|tiêu\s+chí|nội\s+dung|mã|đơn\s+vị|số\s+tiền|tỷ\s+trọng|trạng\s+thái|ngày|tháng|năm|ghi\s+chú)(?![\p{L}\d])"
NUMERIC = r"(?iu)^\s*[-+]?\d[\d\s.,/%₫đ]*\s*$"
HEADER_ROWS = 4


def said(text: Column) -> Column:
    """A text as it is read."""
    return strip(T.replace_all(F.coalesce(text, F.lit("")), SPEECH_RULES))


def box_state(cell: Column) -> Column:
    return F.when(cell.rlike(TICKED), IS_TICKED).when(cell.rlike(OPEN_BOX), IS_OPEN).otherwise("")


def _padded(headers: Column, cells: Column) -> Column:
    """Header and cell of each column, named by its number where there is no header."""
    n = F.greatest(F.size(headers), F.size(cells))
    at = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(
        F.coalesce(F.nullif(F.trim(F.get(headers, i)), F.lit("")), F.concat(F.lit("Cột "), (i + 1).cast("string"))).alias("header"), F.coalesce(F.trim(F.get(cells, i)), F.lit("")).alias("cell"), i.alias("at")))
    return F.when(n > 0, at).otherwise(F.array().cast("array<struct<header:string,cell:string,at:int>>"))


def checked_row(headers: Column, cells: Column) -> Column:
    """Every cell behind its header, empty ones too, for checking."""
    def one(c: Column) -> Column:
        alone = lambda state: (state != "") & (F.trim(F.regexp_replace(c["cell"], BOX, "")) == "")
        return F.concat(c["header"], F.lit(": "), F.when(c["cell"] == "", EMPTY).otherwise(let(box_state(c["cell"]), lambda state: F.when(alone(state), state).otherwise(said(c["cell"])))))

    return F.concat(F.array_join(F.transform(_padded(headers, cells), one), ". "), F.lit("."))


def told_row(headers: Column, cells: Column) -> Column:
    """What a row says: its number, its content, what is ticked, and the rest; empty cells and open boxes aren't read."""
    def row(cols: Column) -> Column:
        find = lambda p: F.get(F.filter(cols, lambda c: c["header"].rlike(p)), F.lit(0))["at"]
        marked = F.transform(cols, lambda c: F.struct(c["header"].alias("header"), c["cell"].alias("cell"), c["at"].alias("at"), box_state(c["cell"]).alias("state")))
        return let(F.struct(find(INDEX).alias("index"), find(CONTENT).alias("named"), marked.alias("cols")), told)

    def told(r: Column) -> Column:
        cols, index, named = r["cols"], r["index"], r["named"]
        cell = lambda at: F.get(cols, at)["cell"]
        other = F.filter(cols, lambda c: ~F.coalesce(c["at"] == index, F.lit(False)) & (c["state"] == ""))
        content = said(F.when(named.isNotNull(), cell(named)).otherwise(F.get(other, F.lit(0))["cell"]))
        number = F.when(index.isNotNull(), said(cell(index))).otherwise("")
        ticked = F.transform(F.filter(cols, lambda c: c["state"] == IS_TICKED), lambda c: c["header"])
        rest = F.filter(F.transform(F.filter(other, lambda c: (c["cell"] != "") & ~F.coalesce(c["at"] == named, F.lit(False))), lambda c: said(c["cell"])), lambda x: x != "")
        return let(F.struct(number.alias("number"), content.alias("content"), ticked.alias("ticked"), rest.alias("rest")), spoken)

    def spoken(r: Column) -> Column:
        parts = F.array_compact(F.array(
            F.when(r["number"] != "", F.concat(F.lit("Mục "), r["number"])), F.when(r["content"] != "", r["content"]), F.when(F.size(r["ticked"]) > 0, F.concat(F.lit("Đã chọn "), F.array_join(r["ticked"], ", "))), F.when(F.size(r["rest"]) > 0, F.array_join(r["rest"], ". "))))
        return let(parts, lambda p: F.when(F.size(p) > 0, F.concat(F.array_join(p, ". "), F.lit("."))).otherwise(""))

    return let(_padded(headers, cells), row)


def header_counts(rows: DataFrame, table: str, number: str, cells: str) -> DataFrame:
    """``table, header_rows``: the first row of each table and up to three below it that look like headers: by their words, by column numbers in brackets, or as words above numbers."""
    order = Window.partitionBy(table).orderBy(number)
    texts = F.transform(F.col(cells), lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    first = lambda t: F.coalesce(F.get(F.filter(t, lambda x: x != ""), F.lit(0)), F.lit(""))
    found = rows.select(table, F.row_number().over(order).alias("nth"), texts.alias("texts"), F.coalesce(first(F.lead(texts).over(order)), F.lit("")).alias("next")).where(F.col("nth") <= HEADER_ROWS)
    own = first(F.col("texts"))
    share = F.when(F.size("texts") > 0, F.size(F.filter("texts", lambda x: x.rlike(NUMERIC))) / F.size("texts")).otherwise(0.0)
    heads = F.array_join("texts", " ").rlike(HEADER_HINT) | (own.rlike(r"^\(\d+\)$") & (share < 0.65)) | (~own.rlike(NUMERIC) & F.col("next").rlike(NUMERIC) & (share < 0.4))
    found = found.withColumn("heads", (F.col("nth") == 1) | heads)
    return found.groupBy(table).agg(F.coalesce(F.min(F.when(~F.col("heads"), F.col("nth"))) - 1, F.max("nth")).cast("int").alias("header_rows"))
