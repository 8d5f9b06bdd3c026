"""Sheets with merged cells: what a cell shows, which columns carry data, headers of several rows, titles above and where the data ends.

``cells`` has ``sheet, row, col, value``, ``merges`` has ``sheet, r1, c1, r2, c2``, both inclusive. Merged rectangles meet cells in a range join: rectangles
are dealt to bands of rows, so a cell meets those of its band alone, and a rectangle that is as long as its sheet isn't expanded into cells.

Null and blank values are empty cells. Sheets without a filled cell have no row. Rectangles that overlap show the first one's value. Repeated cells show the
first value. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import layout as L
from quillon.operators import tables as B
from quillon.sources.shared import written

#: Rows of a band of the range join.
BAND = 64
#: Rows of data that decide on columns, and the share of them that may continue a merged cell.
SAMPLE, CONTINUED = 36, 0.6


def _firsts(entries: Column) -> Column:
    """Of sorted entries the first one of each column."""
    return F.filter(entries, lambda x, i: (i == 0) | (F.get(entries, i - 1)["col"] != x["col"]))


def shown_rows(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """``sheet, row, cells``: each row with a filled cell, once, with what ``merged_values`` says of its cells in the order of their columns.

    Cells are shuffled once, by their row; what lies under rectangles is put into the row's array.
    """
    lines = cells.where(F.trim("value") != "").groupBy("sheet", "row").agg(F.sort_array(F.collect_list(F.struct("col", F.col("value").alias("own")))).alias("all"))
    lines = lines.select("sheet", "row", _firsts(F.col("all")).alias("own"))
    boxes = merges.where("r2 >= r1 AND c2 >= c1").select("sheet", "r1", "c1", "r2", "c2")
    top = F.get(F.filter("own", lambda x: x["col"] == F.col("c1")), F.lit(0))["own"]
    tops = boxes.join(lines.select("sheet", F.col("row").alias("r1"), "own"), ["sheet", "r1"], "left").select("sheet", "r1", "r2", F.struct("r1", "c1", "c2", top.alias("top")).alias("box"))
    # rectangles of one row stand in it; rows of taller ones are met by bands
    flat = tops.where("r1 = r2").select("sheet", F.col("r1").alias("row"), "box")
    banded = tops.where("r2 > r1").withColumn("band", F.explode(F.sequence(F.floor(F.col("r1") / BAND), F.floor(F.col("r2") / BAND))))
    tall = lines.select("sheet", "row", F.floor(F.col("row") / BAND).alias("band")).join(banded, ["sheet", "band"]).where("row BETWEEN r1 AND r2").select("sheet", "row", "box")
    under = flat.unionByName(tall).groupBy("sheet", "row").agg(F.collect_list("box").alias("boxes"))
    spot = lambda b: F.transform(F.sequence(b["c1"], b["c2"]), lambda c: F.struct(c.alias("col"), b["r1"].alias("r1"), b["c1"].alias("c1"), b["top"].alias("top")))
    rows = lines.join(under, ["sheet", "row"], "left").withColumn("spots", F.sort_array(F.flatten(F.transform("boxes", spot))))
    none = F.lit(None).cast(dict(merges.dtypes)["r1"])
    covered = F.transform(_firsts(F.col("spots")), lambda s: F.struct(s["col"].alias("col"), F.lit(0).alias("kind"), s["top"].alias("text"), s["r1"].alias("r1"), s["c1"].alias("c1")))
    owned = F.transform("own", lambda x: F.struct(x["col"].alias("col"), F.lit(1).alias("kind"), x["own"].alias("text"), none.alias("r1"), none.alias("c1")))
    rows = rows.withColumn("both", F.when(F.col("boxes").isNotNull(), F.sort_array(F.concat(covered, owned))).otherwise(owned))
    # a covered cell stands before its own value
    near = lambda i: F.get("both", i)
    kept = F.filter(
        F.transform("both", lambda x, i: F.struct(
            x["col"].alias("col"), x["text"].alias("value"), F.when(x["kind"] == 1, x["text"]).when(near(i + 1)["col"] == x["col"], near(i + 1)["text"]).alias("own"),
            ((x["kind"] == 0) & ((x["r1"] != F.col("row")) | (x["c1"] != x["col"]))).alias("inner"), ((x["kind"] == 0) | (i == 0) | (near(i - 1)["col"] != x["col"])).alias("kept"))),
        lambda x: x["kept"],
    )
    return rows.select("sheet", "row", kept.alias("cells"))


def merged_values(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """``sheet, row, col, value, own, inner``: every cell and every cell under a rectangle within the rows that ``cells`` reach, with the value that it shows;
    ``own`` is its own value, ``inner`` tells whether it continues a rectangle."""
    return shown_rows(cells, merges).select("sheet", "row", F.explode("cells").alias("c")).select("sheet", "row", "c.col", "c.value", "c.own", "c.inner")


def column_name(col: Column) -> Column:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    letter = lambda n: F.char(65 + n)
    n = col.cast("int")
    return F.when(n < 26, letter(n)).when(n < 702, F.concat(letter(F.floor(n / 26) - 1), letter(n % 26))).otherwise(F.concat(letter(F.floor((n - 26) / 676) - 1), letter(F.floor((n - 26) / 26) % 26), letter(n % 26)))


def analysis(cells: DataFrame, merges: DataFrame, folder: str | None = None) -> DataFrame:
    """One row for each sheet: ``header_start, header_end, data_start, data_end, columns, headers, preamble``. What the rows show and the sheets' layouts are written to ``folder`` once, if there is one."""
    shown = shown_rows(cells, merges)
    if folder is not None:
        shown = written(shown, f"{folder}/shown")
    shown = shown.withColumn("sheet", F.col("sheet").cast("string"))
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    lasts = shown.where(F.exists("cells", lambda c: filled(c["value"]))).groupBy("sheet").agg(F.max("row").alias("last"))
    layouts = L.row_layouts(shown, lambda c: B.value_kind(c["value"])).drop("confidence").join(lasts, "sheet")
    if folder is not None:
        layouts = written(layouts, f"{folder}/layouts")
    rows = shown.select("sheet", "row", F.explode("cells").alias("c")).select("sheet", "row", "c.*").join(layouts, "sheet")
    # columns: those that continue rectangles in most of the first data rows carry nothing of their own
    end = F.least(F.col("last"), F.col("data_start") + SAMPLE - 1)
    sampled = F.col("row").between(F.col("data_start"), end)
    heads, shows, owns = F.col("row").between(F.col("header_start"), F.col("header_end")), filled(F.col("value")), filled(F.col("own"))
    columns = rows.groupBy("sheet", "col").agg(
        F.sum((sampled & F.col("inner")).cast("int")).alias("continued"), F.max((heads & shows) | (sampled & owns)).alias("used"), F.max(end - F.col("data_start") + 1).alias("n"),
        F.max(F.when((F.col("row") >= F.col("data_start")) & owns, F.col("row"))).alias("end"),
    )
    columns = columns.where(F.col("used") & ~((F.col("n") > 0) & (F.col("continued") / F.col("n") >= CONTINUED))).select("sheet", "col", "end")
    # headers: the distinct texts of a column's header rows, from above; names that come again are numbered. Titles: what stands above. Both lie within the scanned rows
    top = rows.where((F.col("row") < L.SCAN) & (F.col("row") <= F.col("header_end")) & shows)
    text = F.struct("row", F.trim("value").alias("text"), F.when(heads, T.header_key(F.col("value"))).alias("name"))
    top = top.groupBy("sheet", "col").agg(F.sort_array(F.collect_list(F.when(heads, text))).alias("heads"), F.collect_list(F.when(F.col("row") < F.col("header_start"), F.struct("row", "col", F.trim("value").alias("text")))).alias("above"))
    named = columns.join(top, ["sheet", "col"], "left")
    names = F.transform("heads", lambda x: x["name"])
    parts = F.transform(F.filter("heads", lambda x, i: F.array_position(names, x["name"]) == i + 1), lambda x: x["text"])
    named = named.withColumn("raw", F.when(F.size("heads") > 0, F.array_join(parts, " · ")).otherwise(column_name(F.col("col"))))
    named = named.withColumn("key", T.once(T.header_key(F.col("raw")))).withColumn("key", F.when(F.col("key") == "", F.concat(F.lit("column-"), F.col("col").cast("string"))).otherwise(F.col("key")))
    again = F.row_number().over(Window.partitionBy("sheet", "key").orderBy("col"))
    named = named.withColumn("header", F.when(again == 1, F.col("raw")).otherwise(F.concat("raw", F.lit(" ("), again.cast("string"), F.lit(")"))))
    listed = named.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("col", "header"))).alias("named"), F.sort_array(F.flatten(F.collect_list("above"))).alias("above"), F.max("end").alias("data_end"))
    # titles above the header: the distinct texts of each row
    of_row = lambda r: F.array_distinct(F.transform(F.filter("above", lambda x: x["row"] == r), lambda x: x["text"]))
    preamble = F.transform(F.array_distinct(F.transform("above", lambda x: x["row"])), lambda r: F.array_join(of_row(r), " · "))
    return layouts.join(listed, "sheet").select(
        "sheet", "header_start", "header_end", "data_start", F.coalesce("data_end", F.col("data_start") - 1).cast("int").alias("data_end"), F.transform("named", lambda x: x["col"]).alias("columns"),
        F.transform("named", lambda x: x["header"]).alias("headers"), preamble.alias("preamble"),
    )
