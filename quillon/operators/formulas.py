"""Formulas of sheets that are imported elsewhere: rows moved, sheets renamed, names of 31 characters without collisions.

A formula is cut into tokens (strings, quoted and bare sheet names, cell references, words, others); only tokens of the right kind change, so that a
string that looks like a reference and a function such as LOG10 stay. All of it are column functions.

Null formulas stay null, empty ones empty. Sheets of a workbook are named in their order, each name avoiding all before it, whatever their case. A workbook has a
bounded number of sheets, which are folded; names that aren't in the map stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.segments import _let as let

STRING, QUOTED, BARE = r'"(?:[^"]|"")*"', r"'(?:[^']|'')*'!", r"[A-Za-z_][A-Za-z0-9_.]*!"
WORD, CELL = r"[A-Za-z_$][A-Za-z0-9_.$]*", r"^(\$?[A-Z]{1,3})([0-9]+)$"
TOKEN = f"(?s)({STRING}|{QUOTED}|{BARE}|{WORD}|.)"
#: The most characters of a sheet's name, what it can't hold, and what it is called without any.
NAME, NOT_IN_NAMES, UNNAMED = 31, r"[\\/?*\[\]:]", "Trang tính"


def tokens(formula: Column) -> Column:
    """The parts of a formula, which joined give it back."""
    return F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(1))


def _rewritten(formula: Column, one: Callable[[Column, Column], Column]) -> Column:
    """A formula with each token, and the one behind it, through ``one``."""
    return F.when(formula.isNotNull(), let(tokens(formula), lambda ts: F.array_join(F.transform(ts, lambda t, i: one(t, F.coalesce(F.get(ts, i + 1), F.lit("")))), "")))


def moved(formula: Column, rows: Column) -> Column:
    """Cell references moved by some rows, at least to the first one; absolute rows stay, and functions that look like references."""
    def one(t: Column, behind: Column) -> Column:
        row = F.regexp_extract(t, CELL, 2).try_cast("long")
        return F.when(t.rlike(CELL) & row.isNotNull() & (behind != "("), F.concat(F.regexp_extract(t, CELL, 1), F.greatest(F.lit(1), row + rows).cast("string"))).otherwise(t)

    return F.when(rows == 0, formula).otherwise(_rewritten(formula, one))


def renamed(formula: Column, names: Column) -> Column:
    """References to sheets under their new names (a map); names that aren't plain words are quoted."""
    def one(t: Column, _: Column) -> Column:
        quoted = F.startswith(t, F.lit("'")) & F.endswith(t, F.lit("'!"))
        old = F.when(quoted, F.replace(F.substring(t, F.lit(2), F.length(t) - 3), F.lit("''"), F.lit("'"))).when(t.rlike(f"^{BARE}$"), F.substring(t, F.lit(1), F.length(t) - 1))
        new = F.element_at(names, old)
        plain = new.rlike("^[A-Za-z_][A-Za-z0-9_.]*$") & ~quoted
        return F.when(new.isNull() | (new == old), t).when(plain, F.concat(new, F.lit("!"))).otherwise(F.concat(F.lit("'"), F.replace(new, F.lit("'"), F.lit("''")), F.lit("'!")))

    return _rewritten(formula, one)


def safe_name(name: Column) -> Column:
    """A name that a sheet can have."""
    clean = F.left(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), NOT_IN_NAMES, " "), r"\s+", " ")), F.lit(NAME))
    return F.when(clean == "", UNNAMED).otherwise(clean)


def unique_names(names: Column, taken: Column) -> Column:
    """New names for ``names`` in their order, none of them in ``taken`` or given before; numbers in brackets where they would be."""
    start = F.struct(F.transform(taken, F.lower).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, name: Column) -> Column:
        def pick(base: Column) -> Column:
            numbered = lambda n: F.concat(F.rtrim(F.left(base, F.lit(NAME) - F.length(n.cast("string")) - 3)), F.lit(" ("), n.cast("string"), F.lit(")"))
            tries = F.concat(F.array(base), F.transform(F.sequence(F.lit(2), F.size(state["used"]) + 2), numbered))
            return F.get(F.filter(tries, lambda c: ~F.array_contains(state["used"], F.lower(c))), F.lit(0))

        return let(let(safe_name(name), pick), lambda new: F.struct(F.array_append(state["used"], F.lower(new)).alias("used"), F.array_append(state["out"], new).alias("out")))

    return F.aggregate(names, start, step, lambda s: s["out"])


def imported(sheets: DataFrame, cells: DataFrame, taken: Column) -> DataFrame:
    """``book, sheet, new_sheet, row, col, formula``: formulas of workbooks' sheets (``book, position, sheet`` and ``book, sheet, row, col, formula``) as they stand in a workbook that has the sheets ``taken``."""
    books = sheets.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "sheet"))), lambda s: s["sheet"]).alias("old"))
    books = books.withColumn("names", F.map_from_entries(F.arrays_zip(F.array_distinct("old").alias("old"), unique_names(F.array_distinct("old"), taken).alias("new"))))
    rows = cells.join(books.select("book", "names"), "book")
    return rows.select("book", "sheet", F.element_at("names", F.col("sheet")).alias("new_sheet"), "row", "col", renamed(F.col("formula"), F.col("names")).alias("formula"))
