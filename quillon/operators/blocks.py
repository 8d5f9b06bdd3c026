"""Blocks of recognised pages: titles, headings, articles, lists, check boxes, fields, notes, paragraphs and tables, from lines.

A line's own kind is a column. What reaches beyond a line is windows and islands over a document's lines: tagged and piped runs are tables if
they have two rows, runs of form rows are tables of two columns, open paragraphs go on in the next line. Row groups, merged rows and chains of
paragraphs are folded one by one, so that no fold holds a document.

Null and empty texts have no blocks. Very long texts are sorted by Spark and may spill. Repeated keys are one document: keys should be unique.
Ties can't occur, as lines are numbered. An empty table gives an empty result; only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.session import sound_unions
from quillon.sources.shared import written

#: Lines that are titles, and lines that open headings of either level.
TITLES = r"(?iu)^(?:CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM|Độc lập\s*[-–—]\s*Tự do\s*[-–—]\s*Hạnh phúc|THÔNG TƯ|NGHỊ ĐỊNH|NGHỊ QUYẾT|QUYẾT ĐỊNH|LUẬT|THÔNG BÁO)$"
TITLE_STARTS = r"(?iu)^(?:PHỤ LỤC|BIỂU MẪU HỒ SƠ|THUYẾT MINH CÔNG NGHỆ|ĐƠN ĐỀ NGHỊ|BÁO CÁO THẨM ĐỊNH)"
PART_HEADING, ROMAN_HEADING = r"(?iu)^(?:CHƯƠNG|MỤC|PHẦN)\s+[IVXLCDM\d]+\b", r"^[IVXLCDM]+[.)]\s+"
NUMBER_HEADING = r"^\d+[.)]\s+[A-ZÀ-ỸĐ]"
FORM_HEADING = r"(?iu)^(?:Mẫu\s+số\s+\d+|Số\s*:|Hà Nội,\s*ngày|Kèm theo Thông tư)"
ARTICLE, NOTE = r"(?iu)^Điều\s+\d+[a-z]?\s*[.:-]", r"(?iu)^Ghi chú\s*:"
#: Markers of lists, check boxes, fields to fill in, form rows, and lines that only decorate.
LIST = r"(?iu)^((?:\d+|[a-zđ]|[ivxlcdm]+)[.)])\s+(.+)$"
BOXES, CHECKED = r"^(□|☐|☑|✓|✔|\[\s?[xX]?\s?\])\s*(.+)$", r"(?iu)(?:☑|✓|✔|x)"
FIELD = r"^(.*?)(?:\.{5,}|…{2,}|_{5,})(.*)$"
FORM_ROW = r"(?iu)^Mẫu\s+số\s+(\d{1,3})\s*(?:[|:–—-]\s*)?(.+)$"
DECORATION = ".…·_─━—–-"
#: Words of table headers; the most columns of a table.
HEADER_TOKENS = ["stt", "ho va ten", "noi dung", "linh vuc", "co quan cong tac", "chuc danh", "dat", "khong dat", "nhan xet", "yeu cau giai trinh"]
INDEX_HEADERS = ["stt", "so thu tu"]
MOST_COLUMNS = 10
OPEN_TAG, CLOSE_TAG = r"(?i)^\[TABLE\]$", r"(?i)^\[/TABLE\]$"
ENDED = r"[.;:!?]$"
STRINGS = "array<string>"


def comparable(text: Column) -> Column:
    """What two spellings of a cell or line have in common."""
    return T.normalise_plain(text, "a-z0-9")


def filler(line: Column) -> Column:
    """Whether a line only decorates: dots and dashes, or nearly."""
    compact = F.regexp_replace(line, r"\s+", "")
    n, dots, letters = F.length(compact), F.regexp_count(compact, F.lit(f"[{DECORATION}]")), F.regexp_count(compact, F.lit(r"\p{L}"))
    return (n >= 5) & ((dots == n) | ((dots / n >= 0.72) & (letters <= 2)))


def cells_of(line: Column) -> Column:
    """The cells between pipes, or null if there aren't two of them or all are empty."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    cells = F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c))
    return F.when(F.contains(line, F.lit("|")) & (F.size(cells) >= 2) & F.exists(cells, lambda c: c != ""), cells)


def joined(base: Column, more: Column) -> Column:
    """A text with another behind it, unless it says the same."""
    whole = F.trim(F.regexp_replace(F.concat(base, F.lit(" "), more), r"\s+", " "))
    return F.when(more == "", base).when(base == "", more).when(comparable(base) == comparable(more), base).otherwise(whole)


def lines_of(docs: DataFrame, key: str, text: str, about: str | None = None) -> DataFrame:
    """``key, at, line``: the lines of each text that aren't blank; ``about``, a column of the text, goes with its first line."""
    lines = F.filter(F.transform(F.split(T.tidy(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select(F.col(key).alias("key"), *([F.col(about).alias("about")] if about else []), F.posexplode(lines).alias("at", "line"))
    return rows.withColumn("about", F.when(F.col("at") == 0, F.col("about"))) if about else rows


def _order(*more: str, key: tuple[str, ...] = ("key",)) -> Window:
    return Window.partitionBy(*key, *more).orderBy("at")


def _regions(lines: DataFrame) -> DataFrame:
    """``lines`` with ``run`` (the table that a line belongs to), where it ``begins``, and ``form`` (the run of form rows); at most one of ``run`` and ``form`` isn't null.

    Lines are shuffled with the numbers of their cells, not with these.
    """
    line = F.col("line")
    before, every = _order().rowsBetween(Window.unboundedPreceding, -1), _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, closes = line.rlike(OPEN_TAG), line.rlike(CLOSE_TAG)
    numbers = T.let(cells_of(line), lambda c: F.when(c.isNotNull(), F.struct(F.size(c).alias("n"), F.size(F.filter(c, lambda x: x.rlike(r"^:?-{3,}:?$"))).alias("separators"))))
    rows = lines.withColumn("celled", T.once(numbers)).withColumn("tag", F.when(opens, True).when(closes, False))
    rows = rows.withColumn("tagged", F.coalesce(F.last("tag", ignorenulls=True).over(before), F.lit(False)))
    rows = rows.withColumn("like", F.col("tagged") | F.col("tag").isNotNull() | (F.regexp_count(line, F.lit(r"\|")) >= 2) | line.rlike(r"^\|(?:.*\|)?$"))
    # form rows stand together; if the first of them could be part of a table, the table takes it
    rows = rows.withColumn("is_form", line.rlike(FORM_ROW))
    rows = rows.withColumn("form", F.sum((F.col("is_form") & ~F.coalesce(F.lag("is_form").over(_order()), F.lit(False))).cast("int")).over(every))
    island = Window.partitionBy("key", "is_form", "form")
    rows = rows.withColumn("form", F.when(F.col("is_form") & (F.count(F.lit(1)).over(island) >= 2) & ~F.min_by("like", "at").over(island), F.col("form")))
    # runs of lines like a table's, from the first one that can open a table; a closing tag ends a run
    rows = rows.withColumn("like", F.col("like") & F.col("form").isNull())
    opens_run = F.col("like") & (~F.coalesce(F.lag("like").over(_order()), F.lit(False)) | F.coalesce(~F.lag("tag").over(_order()), F.lit(False)))
    rows = rows.withColumn("run", F.when(F.col("like"), F.sum(opens_run.cast("int")).over(every)))
    began = F.max(F.col("tag").isNotNull() | F.col("celled").isNotNull()).over(_order("run").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("began", began).withColumn("separators", F.col("celled.separators"))
    rows = rows.withColumn("is_row", F.col("began") & F.col("celled").isNotNull() & (F.col("separators") < F.col("celled.n")) & (F.col("separators") < 2))
    of_run = Window.partitionBy("key", "run")
    n_rows = F.sum(F.col("is_row").cast("int")).over(of_run)
    rows = rows.withColumn("begins", F.min(F.when(F.col("began"), F.col("at"))).over(of_run))
    return rows.withColumn("run", F.when(F.col("began") & (n_rows >= 2), F.col("run"))).select(*lines.columns, "tagged", "tag", "separators", "is_row", "run", "begins", "form")


def _width(cells: Column, columns: Column) -> Column:
    """A row with as many cells as the table has columns; cells beyond go to the last one."""
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), columns - F.size(cells))))
    rest = F.array_join(F.filter(F.slice(cells, columns, F.greatest(F.lit(1), F.size(cells))), lambda c: c != ""), " ")
    return F.when(F.size(cells) > columns, F.concat(F.slice(cells, F.lit(1), columns - 1), F.array(rest))).otherwise(padded)


def _table_rows(lines: DataFrame) -> DataFrame:
    """``key, run, begins, at, cells, columns``: the rows of tables, wrapped cells put back, all of one width."""
    line = F.col("line")
    # wrapped header cells stand before separators; tagged text goes on in the last cell
    more = F.when(F.col("cells").isNotNull() & ~F.col("is_row") & (F.col("separators") < F.size("cells")), F.filter("cells", lambda c: (c != "") & ~c.rlike(r"^:?-{3,}:?$")))
    said = F.when(F.col("cells").isNull() & F.col("tagged") & F.col("tag").isNull() & ~filler(line), line)
    rows = lines.withColumn("group", F.sum(F.col("is_row").cast("int")).over(_order("run"))).withColumn("more", more).withColumn("said", said)
    wide = F.max(F.when(~F.col("is_row"), F.col("separators"))).over(Window.partitionBy("key", "run"))
    rows = rows.withColumn("wide", F.coalesce(wide, F.lit(0))).where(F.col("group") > 0)
    parts = F.array_sort(F.collect_list(F.when(~F.col("is_row") & (F.col("more").isNotNull() | F.col("said").isNotNull()), F.struct("at", "more", "said"))))
    each = rows.groupBy("key", "run", "group").agg(F.min("at").alias("at"), F.min_by("cells", "at").alias("cells"), F.max("wide").alias("wide"), F.min("begins").alias("begins"), parts.alias("parts"))

    def onward(cells: Column, part: Column) -> Column:
        n = F.size(cells)
        return F.when(part["more"].isNotNull(), F.concat(cells, part["more"])).otherwise(F.concat(F.slice(cells, F.lit(1), n - 1), F.array(joined(F.element_at(cells, -1), part["said"]))))

    each = each.withColumn("cells", F.aggregate("parts", F.col("cells"), onward))
    longest = F.max(F.size("cells")).over(Window.partitionBy("key", "run"))
    columns = F.when(F.col("wide") >= 2, F.least(F.lit(MOST_COLUMNS), F.col("wide"))).otherwise(F.greatest(F.lit(2), F.least(F.lit(MOST_COLUMNS), longest)))
    each = each.withColumn("columns", columns)
    return each.select("key", "run", "begins", "at", _width(F.col("cells"), F.col("columns")).alias("cells"), "columns")


def _merged_rows(rows: DataFrame) -> DataFrame:
    """Rows that go on in the next one, without a first cell or with the same one, as one row."""
    order = _order("run")
    rows = rows.withColumn("first", comparable(F.get("cells", F.lit(0))))
    last = F.last(F.nullif("first", F.lit("")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.row_number().over(order) == 1) | ((F.col("first") != "") & (last.isNull() | (F.col("first") != last)))
    rows = rows.withColumn("opens", opens).withColumn("group", F.sum(F.col("opens").cast("int")).over(order))
    each = rows.groupBy("key", "run", "group").agg(F.min("at").alias("at"), F.min("begins").alias("begins"), F.max("columns").alias("columns"), F.array_sort(F.collect_list(F.struct("at", "cells"))).alias("parts"))
    fold = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0))["cells"], lambda base, part: F.zip_with(base, part["cells"], joined))
    return each.select("key", "run", "begins", "at", "columns", fold.alias("cells"))


def header_rows(rows: Column) -> Column:
    """1 if the first row heads the table: it begins with a running number or has two known header words."""
    first = F.get(rows, F.lit(0))
    whole = comparable(F.array_join(first, " "))
    words = sum((F.contains(whole, F.lit(t)).cast("int") for t in HEADER_TOKENS), F.lit(0))
    return F.when(comparable(F.get(first, F.lit(0))).isin(INDEX_HEADERS) | (words >= 2), 1).otherwise(0)


def first_column(rows: Column, headers: Column) -> Column:
    """What the first column holds: running numbers, labels, or anything."""
    first = comparable(F.get(F.get(rows, F.lit(0)), F.lit(0)))
    body = F.filter(F.transform(F.slice(rows, headers + 1, F.greatest(F.lit(1), F.size(rows))), lambda r: F.trim(F.get(r, F.lit(0)))), lambda c: c != "")
    indexed = F.size(F.filter(body, lambda c: c.rlike(r"^(?:\d+|\.{2,}|…+)$")))
    return F.when(first.isin(INDEX_HEADERS), "index").when(first.rlike(r"^mau so\s+\d+"), "label").when((F.size(body) >= 2) & (indexed / F.size(body) >= 0.6), "index").otherwise("auto")


def _boxes_moved(row: Column, head: Column) -> Column:
    """A row whose second cell ends with two check boxes has them in the columns for yes and no, if these are empty."""
    names = F.transform(head, comparable)
    yes, no = F.array_position(names, F.lit("dat")).cast("int"), F.array_position(names, F.lit("khong dat")).cast("int")
    second = F.coalesce(F.get(row, F.lit(1)), F.lit(""))
    boxes = F.regexp_extract_all(second, F.lit("(□|☐|☑|✓|✔)"), F.lit(1))
    free = (yes > 0) & (no > 0) & (F.coalesce(F.get(row, yes - 1), F.lit("")) == "") & (F.coalesce(F.get(row, no - 1), F.lit("")) == "") & (F.size(boxes) >= 2)
    rest = F.trim(F.regexp_replace(second, r"(?:\s*(?:□|☐|☑|✓|✔)){2,}\s*$", ""))
    moved = F.transform(row, lambda c, i: F.when(i == yes - 1, F.get(boxes, F.lit(0))).when(i == no - 1, F.get(boxes, F.lit(1))).when(i == 1, rest).otherwise(c))
    return F.when(free, moved).otherwise(row)


def _tables(lines: DataFrame) -> DataFrame:
    """One row for each table."""
    rows = _merged_rows(_table_rows(lines))
    tables = rows.groupBy("key", "run").agg(F.min("begins").alias("at"), F.max("columns").alias("columns"), F.transform(F.array_sort(F.collect_list(F.struct("at", "cells"))), lambda r: r["cells"]).alias("rows"))
    tables = tables.withColumn("header_rows", header_rows(F.col("rows")))
    head = F.get("rows", F.lit(0))
    tables = tables.withColumn("rows", F.transform("rows", lambda r, i: F.when((F.col("header_rows") > 0) & (i >= 1), _boxes_moved(r, head)).otherwise(r)))
    tables = tables.withColumn("first_column", first_column(F.col("rows"), F.col("header_rows")))
    return tables.select("key", "at", F.lit("table").alias("kind"), "rows", "header_rows", "columns", "first_column")


def _forms(lines: DataFrame) -> DataFrame:
    part = lambda n: F.regexp_extract("line", FORM_ROW, n)
    row = F.array(F.concat(F.lit("Mẫu số "), F.when(F.length(part(1)) < 2, F.lpad(part(1), 2, "0")).otherwise(part(1))), F.trim(part(2)))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("at", row.alias("cells")))), lambda r: r["cells"])
    forms = lines.groupBy("key", "form").agg(F.min("at").alias("at"), rows.alias("rows"))
    return forms.select("key", "at", F.lit("table").alias("kind"), "rows", F.lit(0).alias("header_rows"), F.lit(2).alias("columns"), F.lit("label").alias("first_column"))


def heading_level(line: Column) -> Column:
    """2 for parts and Roman numbers, 3 for numbered capitals and lines in capitals, else 0."""
    letters, capitals = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Lu}"))
    n = F.length(line)
    loud = n.between(8, 180) & (letters > 0) & (capitals / letters >= 0.72)
    return F.when(line.rlike(PART_HEADING) | line.rlike(ROMAN_HEADING), 2).when(line.rlike(NUMBER_HEADING) & (n < 180) | loud, 3).otherwise(0)


def line_kind(line: Column) -> Column:
    """A line by itself, as struct of kind, text, and what belongs to the kind (marker or label, value, level, checked); kind null for lines that only decorate."""
    label, value = F.trim(F.regexp_extract(line, FIELD, 1)), F.trim(F.regexp_extract(line, FIELD, 2))
    field = ~F.contains(line, F.lit("|")) & line.rlike(FIELD) & (F.regexp_count(label, F.lit(r"\p{L}")) >= 3)
    level = heading_level(line)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\s*\|{2,}\s*", " "), r"\s+", " "))

    def made(kind: str, text: Column, mark: Column | None = None, value: Column | None = None, level: Column | None = None, checked: Column | None = None) -> Column:
        none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), none(mark, "string").alias("mark"), none(value, "string").alias("value"), none(level, "int").alias("level"), none(checked, "boolean").alias("checked"))

    return (
        F.when(filler(line), F.lit(None))
        .when(line.rlike(BOXES), made("checkbox", F.trim(F.regexp_extract(line, BOXES, 2)), checked=F.regexp_extract(line, BOXES, 1).rlike(CHECKED)))
        .when(field, made("field", F.lit(""), label, F.when(filler(value), "").otherwise(value)))
        .when(line.rlike(NOTE), made("note", line)).when(line.rlike(ARTICLE), made("article", line)).when(line.rlike(FORM_HEADING), made("heading", line, level=F.lit(3)))
        .when(line.rlike(TITLES) | line.rlike(TITLE_STARTS), made("title", line)).when(level > 0, made("heading", line, level=level))
        .when(line.rlike(LIST), made("list", F.trim(F.regexp_extract(line, LIST, 2)), F.regexp_extract(line, LIST, 1)))
        .when((plain == "") | filler(plain), F.lit(None)).otherwise(made("paragraph", plain))
    )


def _paragraphs(units: DataFrame) -> DataFrame:
    """Paragraph lines joined: a paragraph goes on until a line ends it. ``units`` has all blocks and paragraph lines in order."""
    order = _order()
    rows = units.withColumn("same", F.when(F.col("kind") == "paragraph", comparable(F.col("text"))))
    before, further = F.lag("same").over(order), F.lag("same", 2).over(order)
    # a line that repeats the paragraph so far is dropped, so that one that ends with another may leave it open
    over = F.lag("text").over(order).rlike(ENDED) & (further.isNull() | ~F.endswith(before, further))
    opens = F.col("same").isNotNull() & (before.isNull() | over)
    rows = rows.withColumn("opens", F.coalesce(opens, F.lit(False))).withColumn("chain", F.sum(F.col("opens").cast("int")).over(order)).where("kind = 'paragraph'")
    chains = rows.groupBy("key", "chain").agg(F.min("at").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]).alias("texts"))
    start = F.struct(F.array().cast(STRINGS).alias("done"), F.lit("").alias("now"))

    def step(state: Column, text: Column) -> Column:
        ended = state["now"].rlike(ENDED)
        return F.struct(F.when(ended, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"), F.when(ended, text).otherwise(joined(state["now"], text)).alias("now"))

    whole = F.aggregate("texts", start, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    return chains.select("key", "at", F.posexplode(whole).alias("nth", "text"), F.lit("paragraph").alias("kind"))


def build_blocks(docs: DataFrame, key: str, text: str, folder: str | None = None, about: str | None = None) -> DataFrame:
    """``key, place, kind, text, mark, value, level, checked, rows, header_rows, columns, first_column``: the blocks of each text, ``place`` from 1 in their order.

    Tables, forms, single lines and paragraphs come from the same lines, which are written to ``folder`` once, with the tables, if there is one, and found anew for each otherwise.
    ``about`` is a column of ``docs`` that comes with each block; texts whose key is null have no blocks then.
    """
    sound_unions(docs.sparkSession)
    # a line's kind and its cells are found once, while lines are written; exploding them keeps the filter behind from finding them again
    kind = F.when(F.col("run").isNull() & F.col("form").isNull(), line_kind(F.col("line")))
    lines = _regions(lines_of(docs, key, text, about)).withColumn("k", T.once(kind)).withColumn("cells", T.once(F.when(F.col("run").isNotNull(), cells_of(F.col("line")))))
    # what a line says is held once: by its kind, by its cells, or by itself
    lines = lines.withColumn("line", F.when(F.col("form").isNotNull() | (F.col("run").isNotNull() & F.col("cells").isNull()), F.col("line")))
    if folder is not None:
        lines = written(lines, f"{folder}/lines", codec="zstd")
    tables = _tables(lines.where("run IS NOT NULL").drop("k", "about")).unionByName(_forms(lines.where("form IS NOT NULL").drop("k", "about")))
    if folder is not None:
        tables = written(tables, f"{folder}/tables", codec="zstd")
    single = lines.where("run IS NULL AND form IS NULL AND k IS NOT NULL").select("key", "at", "k.*")
    units = single.select("key", "at", "kind", "text").unionByName(tables.select("key", "at", "kind", F.lit(None).cast("string").alias("text")))
    every = single.where("kind <> 'paragraph'").withColumn("nth", F.lit(0)).unionByName(_paragraphs(units), allowMissingColumns=True).unionByName(tables.withColumn("nth", F.lit(0)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("key").orderBy("at", "nth"))
    blocks = every.select("key", place.alias("place"), "kind", "text", "mark", "value", "level", "checked", "rows", "header_rows", "columns", "first_column")
    if about:  # places have dealt blocks by key already, so that the join moves what is said of texts alone
        blocks = blocks.join(lines.where("at = 0").select("key", F.col("about").alias(about)), "key")
    return blocks.withColumnRenamed("key", key)
