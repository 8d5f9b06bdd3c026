"""Merged cells against brute force, and the analysis of small sheets."""

import random

from quillon.operators import sheets as S

CELLS, MERGES = "sheet STRING, row INT, col INT, value STRING", "sheet STRING, r1 INT, c1 INT, r2 INT, c2 INT"


def test_shown_values_equal_brute_force(spark):
    rng = random.Random(5)
    cells = [(s, r, c, rng.choice(["a", "b", "", None, " ", f"v{r}"])) for s in ("x", "y") for r in range(0, 300, 3) for c in range(6) if rng.random() < 0.7]
    merges = []
    for s in ("x", "y", "z"):
        for _ in range(12):
            r, c = rng.randrange(300), rng.randrange(6)
            merges.append((s, r, c, r + rng.choice([0, 1, 5, 200]), c + rng.choice([0, 1, 3])))
    merges.append(("x", 5, 5, 4, 4))  # no rectangle
    own = {(s, r, c): v for s, r, c, v in cells if v and v.strip()}
    lines = {(s, r) for s, r, _ in own}
    want = {k: (v, v, False) for k, v in own.items()}
    for s, r in lines:
        for c in range(12):
            boxes = sorted((r1, c1) for t, r1, c1, r2, c2 in merges if t == s and r1 <= r <= r2 and c1 <= c <= c2)
            if boxes:
                top = min(((r1, c1, own.get((s, r1, c1))) for r1, c1 in boxes), key=lambda x: (x[0], x[1]))
                want[s, r, c] = (top[2], own.get((s, r, c)), (r, c) != top[:2])
    got = S.merged_values(spark.createDataFrame(cells, CELLS), spark.createDataFrame(merges, MERGES)).collect()
    assert {(r["sheet"], r["row"], r["col"]): (r["value"], r["own"], r["inner"]) for r in got} == want


def test_headers_titles_and_ends(spark):
    rows = [["BÁO CÁO", "", "", ""], ["STT", "Tên", "Tên", ""], ["", "Họ", "Họ", "Ghi chú"], ["1", "An", "Bình", "x"], ["2", "Chi", "Dung", "y"], ["3", "Em", "Phúc", "z"], ["4", "Giang", "Hà", ""], ["", "", "", " "]]
    cells = [("s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    merges = [("s", 0, 0, 0, 3), ("s", 1, 0, 2, 0)]
    got = S.analysis(spark.createDataFrame(cells, CELLS), spark.createDataFrame(merges, MERGES)).first()
    assert (got["header_start"], got["header_end"], got["data_start"], got["data_end"]) == (1, 2, 3, 6) and got["preamble"] == ["BÁO CÁO"]
    assert got["columns"] == [0, 1, 2, 3] and got["headers"] == ["STT", "Tên · Họ", "Tên · Họ (2)", "Ghi chú"]
    empty = spark.createDataFrame([("e", 0, 0, None)], CELLS)
    assert S.analysis(empty, spark.createDataFrame([], MERGES)).count() == 0


def test_column_names(spark):
    want = ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAB", "XFD"]
    got = spark.createDataFrame([(n,) for n in (0, 25, 26, 51, 52, 701, 702, 703, 16383)], "n INT").select(S.column_name(S.F.col("n")).alias("c")).collect()
    assert [r["c"] for r in got] == want


def test_layouts_are_found_once(spark, tmp_path):
    rows = [["STT", "Tên", "Ngày"], *[[str(n), f"An {n}", "01/02/2026"] for n in range(6)]]
    cells = spark.createDataFrame([("s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)] + [("s", 1, 1, "An 9")], CELLS)
    merges = spark.createDataFrame([("s", 2, 1, 2, 2)], MERGES)
    found = S.analysis(cells, merges, f"file://{tmp_path}")
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("window [") == 1
    assert found.collect() == S.analysis(cells, merges).collect()
    shown = S.merged_values(cells, merges).where("value IS NOT NULL")
    kind = lambda c: S.B.value_kind(c)
    assert S.L.sheet_layouts(shown, kind(S.F.col("value"))).collect() == S.L.row_layouts(S.shown_rows(cells, merges), lambda c: kind(c["value"])).collect()
