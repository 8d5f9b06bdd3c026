"""Tables and paragraphs that cross pages, whole again.

Blocks of all pages (``blocks.build_blocks``) stand in one order. A table goes on from the one before if it stands beside it on a page or opens the
next page, and its header is the same or it goes on counting without one. Which header holds for a table without one is a window, so links
don't depend on a walk over pages; a chain of any length is an island of links. Rows cut by a page end, and text that a page begins
with in front of its table, go back into the row that they belong to. Only consecutive pages are joined.

Null texts are pages without blocks. Repeated pages of a document stand for themselves, in order of their text. Documents without tables have no
rows; an empty table gives an empty result. Other columns than document, page and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import blocks as B
from quillon.sources.shared import written

#: Headers of columns for running numbers, contents, yes and no; openings that never go on from a page before.
INDEX_COLUMN, CONTENT_COLUMN, YES_COLUMN, NO_COLUMN = r"^stt$|^so thu tu$", r"noi dung|ho va ten|ten mau|tieu chi", r"^dat$", r"^khong dat$"
OPENINGS = r"(?iu)^(?:Điều|Chương|Mục|Phần|Phụ lục|Mẫu số|CỘNG HÒA|THÔNG TƯ|NGHỊ ĐỊNH|QUYẾT ĐỊNH)\b"
COUNTED = r"^(?:\d+|\.{2,}|…+)$"
BOX = "(□|☐|☑|✓|✔)"
#: The most characters of a text that goes on from the page before.
MOST = 520


def goes_on(kind: Column, text: Column) -> Column:
    """Whether a paragraph may be the rest of what a page before holds: it begins small or doesn't end."""
    value = F.trim(text)
    return F.coalesce((kind == "paragraph") & (value != "") & (F.length(value) <= MOST) & ~value.rlike(OPENINGS) & (value.rlike(r"^[a-zà-ỹđ(,;:]") | ~value.rlike(r"[.!?:;]$")), F.lit(False))


def appended(base: Column, more: Column) -> Column:
    """A cell with its rest, unless it ends with it already."""
    left, right = B.comparable(base), B.comparable(more)
    whole = F.trim(F.regexp_replace(F.concat(base, F.lit(" "), more), r"\s+", " "))
    return F.when(more == "", base).when(base == "", more).when((right == "") | F.endswith(left, right), base).otherwise(whole)


def _column(header: Column, pattern: str) -> Column:
    """The first column whose header fits, from 0; -1 for none."""
    at = F.array_position(F.transform(header, lambda c: B.comparable(c).rlike(pattern)), True)
    return (F.coalesce(at, F.lit(0)) - 1).cast("int")


def _fitted(row: Column, of: Column) -> Column:
    """A row of a table without header, under the columns of the table that it goes on from: number, text, and check boxes in their order."""
    values = F.transform(row, lambda c: F.trim(c))
    counted = F.get(values, F.lit(0)).rlike(COUNTED)
    rest = F.filter(F.when(counted, F.slice(values, F.lit(2), F.greatest(F.lit(1), F.size(values)))).otherwise(values), lambda c: c != "")
    boxes = F.flatten(F.transform(rest, lambda c: F.regexp_extract_all(c, F.lit(BOX), F.lit(1))))
    texts = F.filter(F.transform(rest, lambda c: F.trim(F.regexp_replace(c, r"(?:\s*(?:□|☐|☑|✓|✔))+\s*$", ""))), lambda c: c != "")
    said = F.trim(F.regexp_replace(F.array_join(texts, " "), r"\s+", " "))
    own = lambda i: F.when(F.size(row) == of["columns"], F.coalesce(F.get(values, i), F.lit(""))).otherwise("")
    made = lambda i: (
        F.when((i == of["no"]) & (F.size(boxes) > 1), F.get(boxes, F.lit(1))).when((i == of["yes"]) & (F.size(boxes) > 0), F.get(boxes, F.lit(0)))
        .when(i == of["content"], said).when((i == of["index"]) & counted, F.get(values, F.lit(0))).otherwise("")
    )
    return F.transform(F.sequence(F.lit(0), of["columns"] - 1), lambda i: F.when(made(i) == "", own(i)).otherwise(made(i)))


def page_blocks(pages: DataFrame, doc: str, page: str, text: str, folder: str | None = None) -> DataFrame:
    """Blocks of pages with ``doc, page`` and ``seq``, their order in the document; written to ``folder`` if there is one, because what is stitched reads them several times."""
    named = pages.select(F.struct(F.col(doc).alias("doc"), F.col(page).cast("long").alias("page"), F.xxhash64(text).alias("copy")).alias("id"), F.col(text).alias("text"))
    blocks = B.build_blocks(named, "id", "text", folder).select("id.doc", "id.page", "id.copy", "*").drop("id")
    blocks = blocks.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("page", "copy", "place")))
    return written(blocks, f"{folder}/blocks") if folder is not None else blocks


def linked_tables(blocks: DataFrame) -> DataFrame:
    """Tables in order, with ``chain``: whether each goes on from the one before."""
    order = Window.partitionBy("doc").orderBy("seq")
    rows = blocks.withColumn("breaks", F.sum((~goes_on(F.col("kind"), F.col("text")) & (F.col("kind") != "table")).cast("int")).over(order))
    rows = rows.where("kind = 'table'").select("doc", "page", "seq", "breaks", "rows", "header_rows", "columns", "first_column")
    head = F.when(F.col("header_rows") > 0, F.array_join(F.transform(F.flatten(F.slice("rows", F.lit(1), F.greatest(F.lit(1), F.col("header_rows")))), B.comparable), "|"))
    number = lambda r: F.when(F.get(r, F.lit(0)).rlike(r"^\s*\d+\s*$"), F.trim(F.get(r, F.lit(0))).try_cast("long"))
    rows = rows.withColumn("head", head).withColumn("first", F.get("rows", F.col("header_rows"))).withColumn("last", F.when(F.size("rows") > F.col("header_rows"), F.element_at("rows", -1)))
    rows = rows.withColumn("begins", number(F.col("first"))).withColumn("ends", number(F.col("last")))
    before = lambda c: F.lag(c).over(order)
    same_page = (before("page") == F.col("page")) & (before("breaks") == F.col("breaks"))
    next_page = before("page") + 1 == F.col("page")
    rows = rows.withColumn("beside", F.coalesce(same_page, F.lit(False))).withColumn("onward", F.coalesce(next_page, F.lit(False)))
    rows = rows.withColumn("before_index", before("first_column") == "index").withColumn("counts", F.coalesce(F.col("begins").isin(before("ends"), before("ends") + 1), F.lit(False)))
    # the header that holds: that of the last table with one, as long as all tables behind it go on
    rows = rows.withColumn("group", F.sum((F.col("head").isNotNull()).cast("int")).over(order))
    inside = Window.partitionBy("doc", "group").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = F.coalesce(F.first("first_column").over(inside) == "index", F.lit(False)) & (F.col("group") > 0)
    counted = F.coalesce(F.trim(F.get("first", F.lit(0))).rlike(COUNTED), F.lit(False))
    bare = F.when(F.col("beside"), F.coalesce((F.col("before_index") | index) & F.col("counts"), F.lit(False))).otherwise(F.col("onward") & index & counted)
    rows = rows.withColumn("bare", F.col("head").isNotNull() | bare)
    rows = rows.withColumn("holds", F.min("bare").over(inside) & (F.col("group") > 0)).withColumn("held", F.when(F.col("holds"), F.first("head").over(inside)))
    width = F.first("columns").over(inside)
    repeats = (F.col("head") == F.lag("held").over(order)) & (F.col("columns") == F.lag("width").over(order)) & (F.col("beside") | F.col("onward"))
    rows = rows.withColumn("width", width)
    goes = F.when(F.col("head").isNotNull(), F.coalesce(repeats, F.lit(False))).when(F.col("beside"), F.col("bare")).otherwise(F.col("holds") & F.col("onward"))
    rows = rows.withColumn("goes", goes).withColumn("chain", F.sum((~F.col("goes")).cast("int")).over(order))
    return rows.select("doc", "page", "seq", "rows", "header_rows", "columns", "first_column", "beside", "goes", "chain")


def _loose_texts(blocks: DataFrame) -> DataFrame:
    """``doc, seq, text``: texts that go on from the last row of the table ``seq``: between two of its parts on a page, or in front of the next page's table."""
    order = Window.partitionBy("doc").orderBy("seq")
    rows = blocks.select("doc", "page", "seq", "kind", "text", goes_on(F.col("kind"), F.col("text")).alias("on")).withColumn("is_table", F.col("kind") == "table")
    rows = rows.withColumn("nth", F.sum(F.col("is_table").cast("int")).over(order))
    last = F.when(F.col("is_table"), F.struct("page", "seq"))
    rows = rows.withColumn("behind", F.last(last, ignorenulls=True).over(order)).withColumn("ahead", F.first(last, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    loose = rows.where(~F.col("is_table") & (F.col("ahead.page") == F.col("page")) & F.col("behind.page").isin(F.col("page"), F.col("page") - 1))
    loose = loose.groupBy("doc", "nth").agg(
        F.min("on").alias("every"), F.min("behind.seq").alias("seq"), F.min("ahead.seq").alias("before"), F.min((F.col("behind.page") == F.col("page")).cast("int")).alias("beside"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), " ").alias("text"),
    )
    return loose.where("every").select("doc", "seq", "before", F.col("beside") == 1, F.trim("text").alias("said")).toDF("doc", "seq", "before", "inner", "said")


def stitched_tables(blocks: DataFrame) -> DataFrame:
    """``doc, table, first_page, last_page, parts, header_rows, columns, rows, cut_rows, unclear_rows``: each table whole, ``table`` from 1 by its place."""
    tables = linked_tables(blocks)
    order = Window.partitionBy("doc", "chain").orderBy("seq")
    first = lambda c: F.first(c).over(order)
    header = F.when(first("header_rows") > 0, F.get(first("rows"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    columns = first("columns")
    content = F.when(_column(F.col("header"), CONTENT_COLUMN) >= 0, _column(F.col("header"), CONTENT_COLUMN)).otherwise(F.least(F.lit(1), F.col("wide") - 1))
    tables = tables.withColumn("header", header).withColumn("wide", columns).withColumn("heads", first("header_rows")).withColumn("part", F.row_number().over(order))
    of = F.struct(F.col("wide").alias("columns"), F.greatest(F.lit(0), _column(F.col("header"), INDEX_COLUMN)).alias("index"), content.alias("content"), _column(F.col("header"), YES_COLUMN).alias("yes"), _column(F.col("header"), NO_COLUMN).alias("no"))
    tables = tables.withColumn("of", of)
    # the first part stays as it is, header and all; a repeated header goes; rows without one, and those beside on a page, are fitted
    body = F.slice("rows", F.col("header_rows") + 1, F.greatest(F.lit(1), F.size("rows")))
    fitted = F.transform(body, lambda r: _fitted(r, F.col("of")))
    own = F.when(F.col("part") == 1, F.col("rows")).when(F.col("beside") | (F.col("header_rows") == 0), fitted).otherwise(body)
    boxes = F.transform(body, lambda r: F.size(F.regexp_extract_all(F.array_join(r, " "), F.lit(BOX), F.lit(1))) == 1)
    unclear = F.when((F.col("part") > 1) & (F.col("header_rows") == 0) & (F.col("of.yes") >= 0) & (F.col("of.no") >= 0), F.size(F.filter(boxes, lambda b: b))).otherwise(0)
    tables = tables.withColumn("own", own).withColumn("unclear", unclear)

    rows = tables.select("doc", "chain", "seq", "part", "heads", "of", "beside", "header_rows", F.posexplode("own").alias("at", "cells"))
    line = Window.partitionBy("doc", "chain").orderBy("seq", "at")
    number = F.when(F.get("cells", F.lit(0)).rlike(r"^\d+$"), F.get("cells", F.lit(0)))
    cut = (F.col("part") > 1) & (F.col("at") == 0) & ~F.col("beside") & (F.col("header_rows") == 0) & (F.lag("number").over(line) == F.col("number"))
    rows = rows.withColumn("number", number).withColumn("cut", F.coalesce(cut, F.lit(False))).withColumn("said", F.lit(None).cast("string"))
    # loose texts go behind the last row of their table, if that isn't its header
    loose = _loose_texts(blocks).join(tables.select("doc", "seq", "chain", "part", "heads", "of", F.size("own").alias("n")), ["doc", "seq"]).where((F.col("part") > 1) | (F.col("n") > F.col("heads")))
    inner = tables.where("goes AND beside").select("doc", F.col("seq").alias("before"))
    loose = loose.where(~F.col("inner")).unionByName(loose.where("inner").join(inner, ["doc", "before"], "left_semi").select(loose.columns))
    texts = loose.select("doc", "chain", "seq", "of", F.col("n").alias("at"), F.array().cast("array<string>").alias("cells"), F.lit(True).alias("cut"), "said")
    every = rows.select("doc", "chain", "seq", "of", "at", "cells", "cut", "said").unionByName(texts)
    every = every.withColumn("row", F.sum((~F.col("cut")).cast("int")).over(line))
    parts = F.array_sort(F.collect_list(F.struct("seq", "at", "cells", "said")))
    whole = every.groupBy("doc", "chain", "row").agg(parts.alias("parts"), F.max("of").alias("of"), F.sum((F.col("cut") & F.col("said").isNull()).cast("int")).alias("cut_rows"))

    def onward(base: Column, part: Column) -> Column:
        said = F.transform(base, lambda c, i: F.when(i == F.col("of.content"), appended(c, part["said"])).otherwise(c))
        return F.when(part["said"].isNotNull(), said).otherwise(F.transform(base, lambda c, i: appended(c, F.coalesce(F.get(part["cells"], i), F.lit("")))))

    whole = whole.withColumn("cells", F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0))["cells"], onward))
    made = whole.groupBy("doc", "chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows"), F.sum("cut_rows").alias("cut_rows"))
    about = tables.groupBy("doc", "chain").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("parts"), F.min("heads").alias("header_rows"), F.min("wide").alias("columns"), F.sum("unclear").alias("unclear_rows"))
    out = about.join(made, (about["chain"] == made["chain"]) & about["doc"].eqNullSafe(made["doc"])).select(about["doc"], about["chain"].alias("table"), "first_page", "last_page", "parts", "header_rows", "columns", "rows", "cut_rows", "unclear_rows")
    return out


def stitched_paragraphs(blocks: DataFrame) -> DataFrame:
    """``doc, first_page, last_page, text``: paragraphs that the end of a page cuts and the next page's first block goes on with, whole, over any number of pages."""
    page = Window.partitionBy("doc", "page").orderBy("seq")
    order = Window.partitionBy("doc").orderBy("seq")
    rows = blocks.select("doc", "page", "seq", "kind", "text", F.row_number().over(page).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("doc", "page")).alias("n"))
    open_ = (F.col("kind") == "paragraph") & ~F.col("text").rlike(B.ENDED) & (F.col("nth") == F.col("n"))
    rows = rows.withColumn("open", F.coalesce(open_, F.lit(False)))
    goes = F.lag("open").over(order) & (F.lag("page").over(order) + 1 == F.col("page")) & (F.col("nth") == 1) & goes_on(F.col("kind"), F.col("text"))
    rows = rows.withColumn("goes", F.coalesce(goes, F.lit(False))).withColumn("chain", F.sum((~F.col("goes")).cast("int")).over(order)).where("kind = 'paragraph'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"])
    whole = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0)), B.joined)
    found = rows.groupBy("doc", "chain").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), parts.alias("parts"))
    return found.where("last_page > first_page").select("doc", "first_page", "last_page", whole.alias("text"))
