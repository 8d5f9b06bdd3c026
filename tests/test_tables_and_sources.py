import io
import zipfile

from pyspark.sql import functions as F

from quillon.operators import policies as P
from quillon.operators import formulas as X
from quillon.operators import tables as B
from quillon.plans import layout
from quillon.sources import readers as S


def test_layouts_of_golden_sheets(spark):
    rows = {r["sheet"]: r for r in layout.cases(spark).collect()}
    report, grouped = rows["report"], rows["grouped"]
    assert (report["header_start"], report["header_end"], report["data_start"]) == (2, 2, 3) and report["confidence"] == 1
    assert (grouped["header_start"], grouped["header_end"], grouped["data_start"]) == (0, 1, 2)


def test_formula_shift_keeps_absolute_rows(spark):
    rows = spark.createDataFrame([("IF(A7=$B$2,C7-D7,0)", 3), (None, 1), ("A1", 0), ("A2", -5)], "f STRING, n INT")
    assert [r[0] for r in rows.select(X.moved(F.col("f"), F.col("n"))).collect()] == ["IF(A10=$B$2,C10-D10,0)", None, "A1", "A1"]


def test_delimited_files_become_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,\n")
    got = sorted((r["row"], r["col"], r["value"]) for r in S.delimited(spark, f"file://{tmp_path}/a.csv").collect())
    assert got == [(1, 0, "x"), (1, 1, "y"), (2, 0, "1"), (2, 1, "")]
    assert S.delimited(spark, f"file://{tmp_path}/a.csv", rows=1, columns=1).count() == 1
    assert [r["truncated"] for r in S.delimited(spark, f"file://{tmp_path}/a.csv", rows=1, columns=1).collect()] == [True]
    (tmp_path / "b.csv").write_text('a,"b, c",d\n"two\nlines","say ""so""",\n')
    quoted = S.delimited(spark, f"file://{tmp_path}/b.csv").collect()
    assert sorted((r["row"], r["col"], r["value"]) for r in quoted) == [(1, 0, "a"), (1, 1, "b, c"), (1, 2, "d"), (2, 0, "two\nlines"), (2, 1, 'say "so"'), (2, 2, "")]
    assert not any(r["truncated"] for r in quoted)


def test_formats(spark):
    rows = spark.createDataFrame([("a.DOCX", None), ("b", "application/pdf"), ("c.htm", None), ("d.tsv", ""), (None, None)], "n STRING, m STRING")
    assert [r[0] for r in rows.select(S.format_of(F.col("n"), F.col("m"))).collect()] == ["docx", "pdf", "html", "delimited", "plain"]


def test_docx_text(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word\\document.xml", "<w:document><w:p><w:r><w:t>A &amp; B</w:t></w:r></w:p><w:p><w:t xml:space='preserve'>two</w:t><w:tab/><w:t>three</w:t></w:p></w:document>")
    rows = spark.createDataFrame([(bytearray(data.getvalue()),), (bytearray(b"no"),), (None,)], "c BINARY")
    assert [r[0] for r in rows.select(S.docx_text("c")).collect()] == ["A & B\ntwo\tthree", None, None]


def test_gazette_attachments_prefer_docx(spark, sf_dir):
    from quillon.plans.policies import gazette_files

    rows = [(r["url"], r["priority"], r["rank"]) for r in gazette_files(spark, sf_dir).orderBy("rank").collect()]
    assert rows == [("u2", 0, 1), ("u1", 0, 2)]


def test_block_roles_carry_state(spark):
    lines = ["Phụ lục I", "DANH MỤC HỒ SƠ KÊ KHAI", "(Kèm theo Thông tư)", "Nơi nhận:", "KT. BỘ TRƯỞNG", "Nguyễn Văn An", "Nguyễn Văn An", "QUY ĐỊNH CHUNG VỀ THUẾ", "một dòng thường."]
    rows = spark.createDataFrame([(1, n, x) for n, x in enumerate(lines)] + [(2, 0, "Nguyễn Văn An")], "doc INT, at INT, line STRING")
    got = {(r["key"], r["at"]): r["role"] for r in P.block_roles(rows, "doc", "at", "line").collect()}
    assert [got[1, n] for n in range(len(lines))] == ["appendix-title", "appendix-note", "appendix-note", "recipients", "signature-role", "signer-name", "normal", "section-title", "normal"]
    assert got[2, 0] == "normal"
