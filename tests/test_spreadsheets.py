"""Workbooks: round trips, sheets that are full, failed tasks, truncation."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.sources import spreadsheets as W

ODD = [(1, "a", 1.5, True), (2, None, None, None), (3, "", -0.0, False), (4, " <&>'\" \n é 世界 ", 1e300, True), (5, "x\x00y\x0bz", float("nan"), None), (6, "=1+1", float("inf"), None), (2**53, "1", 0.1, None)]


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(W.Workbooks)
    return spark


def values(df, names):
    cells = df.where("row > 0").groupBy("file", "sheet", "row").pivot("col", list(range(len(names)))).agg(F.first("value"))
    return cells.toDF("file", "sheet", "row", *names)


def test_round_trip_of_orders(source, sf_dir, tmp_path):
    orders = source.read.parquet(f"{sf_dir}/orders.parquet")
    path = f"file://{tmp_path}/books"
    orders.repartition(3).write.format("workbook").mode("append").save(path)
    assert sorted(p.suffix for p in (tmp_path / "books").iterdir()) == [".xlsx"] * 3
    cells = source.read.format("workbook").load(path)
    back = values(cells, orders.columns).select(*[F.col(c).cast(t).alias(c) for c, t in orders.dtypes])
    assert back.exceptAll(orders).count() == orders.exceptAll(back).count() == 0
    assert cells.where("truncated").count() == 0


def test_odd_values_and_full_sheets(source, tmp_path):
    df = source.createDataFrame(ODD, "n LONG, s STRING, d DOUBLE, b BOOLEAN").coalesce(1)
    df.write.format("workbook").mode("append").option("sheetRows", 4).save(f"file://{tmp_path}/b")
    cells = source.read.format("workbook").load(f"file://{tmp_path}/b").collect()
    assert {r["sheet"] for r in cells} == {"Sheet1", "Sheet2", "Sheet3"} and {r["value"] for r in cells if r["row"] == 0 and r["sheet"] == "Sheet3"} == {"n", "s", "d", "b"}
    said = {(r["sheet"], r["row"], r["col"]): r["value"] for r in cells}
    assert said["Sheet1", 1, 0] == "1" and said["Sheet1", 1, 3] == "TRUE" and ("Sheet1", 2, 1) not in said and said["Sheet1", 3, 1] == "" and said["Sheet2", 1, 1] == " <&>'\" \n é 世界 "
    assert said["Sheet2", 2, 1] == "xyz" and said["Sheet2", 2, 2] == "nan" and said["Sheet2", 3, 1] == "=1+1" and said["Sheet3", 1, 0] == str(2**53) and said["Sheet3", 1, 2] == "0.1"


def test_a_failed_task_leaves_no_file(source, tmp_path):
    df = source.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        df.write.format("workbook").mode("append").save(f"file://{tmp_path}/gone")
    assert not (tmp_path / "gone").exists() or not list((tmp_path / "gone").iterdir())


def test_overwrite_append_and_empty(source, tmp_path):
    path = f"file://{tmp_path}/o"
    one = source.createDataFrame([("a",)], "v STRING").coalesce(1)
    for mode, count in (("append", 1), ("append", 2), ("overwrite", 1)):
        one.write.format("workbook").mode(mode).save(path)
        assert len(list((tmp_path / "o").iterdir())) == count
    one.limit(0).write.format("workbook").mode("overwrite").save(path)
    assert not list((tmp_path / "o").iterdir()) and source.read.format("workbook").load(path).count() == 0


def test_truncation_is_told(source, tmp_path):
    path = f"file://{tmp_path}/t"
    source.range(10).coalesce(1).write.format("workbook").mode("append").save(path)
    cells = source.read.format("workbook").option("maxRows", 4).load(path).orderBy("row").collect()
    assert [(r["value"], r["truncated"]) for r in cells] == [("id", False), ("0", False), ("1", False), ("2", True)]
    assert source.read.format("workbook").option("maxRows", 11).load(path).where("truncated").count() == 0


def test_shared_strings_and_missing_references():
    out = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f"<workbook xmlns='{ns}' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='Tờ 1' sheetId='1' r:id='x'/></sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='x' Target='/xl/worksheets/a.xml'/></Relationships>")
        book.writestr("xl/sharedStrings.xml", f"<sst xmlns='{ns}'><si><t>một</t></si><si><r><t>ha</t></r><r><t>i</t></r><rPh><t>x</t></rPh></si></sst>")
        book.writestr("xl/worksheets/a.xml", f"<worksheet xmlns='{ns}'><sheetData><row r='2'><c t='s'><v>0</v></c><c/><c t='s'><v>1</v></c></row><row><c r='AB3' t='str'><f>A1</f><v>kq</v></c></row></sheetData></worksheet>")
    out.seek(0)
    assert list(W.read_cells(out)) == [("Tờ 1", 1, 0, "một", False), ("Tờ 1", 1, 2, "hai", False), ("Tờ 1", 2, 27, "kq", False)]
