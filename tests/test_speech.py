"""Rows read aloud and header rows: published cases and edge cases."""

from pyspark.sql import functions as F

from quillon.operators import speech as A

SHAPE = "id INT, h ARRAY<STRING>, c ARRAY<STRING>"


def test_rows(spark):
    rows = [
        (1, ["STT", "Nội dung tiêu chí", "Đạt", "Không đạt", "Nhận xét"], ["3", "Có khả năng tạo ra sản phẩm", "☑", "□", ""]), (2, ["STT", "Nội dung", "Đạt", "Không đạt"], ["2", "Tiêu chí hai", "□", ""]),
        (3, [], ["một", None, "hai ☑ ba"]), (4, ["STT"], []), (5, [], []), (6, ["Số thứ tự", "Tên mẫu"], ["7", "Mẫu 01", "thêm", "[không đọc rõ]"]), (7, ["a", "b"], ["x", "y"]),
    ]
    got = {r["id"]: (r["t"], r["k"]) for r in spark.createDataFrame(rows, SHAPE).select("id", A.told_row(F.col("h"), F.col("c")).alias("t"), A.checked_row(F.col("h"), F.col("c")).alias("k")).collect()}
    assert got[1][0] == "Mục 3. Có khả năng tạo ra sản phẩm. Đã chọn Đạt." and "Đạt: chưa đánh dấu" in got[2][1] and "Không đạt: để trống" in got[2][1]
    assert got[3][0] == "một. Đã chọn Cột 3. một." and got[3][1] == "Cột 1: một. Cột 2: để trống. Cột 3: hai ô đã đánh dấu ba."
    assert got[4] == ("", "STT: để trống.") and got[5] == ("", ".") and got[6][0] == "Mục 7. Mẫu 01. thêm. không đọc rõ." and got[7][0] == "x. x. y."


def test_header_counts(spark):
    tables = {
        1: [["Tên", "Giá"], ["A", "1"], ["B", "2"]], 2: [["STT", "Nội dung"], ["(1)", "(2)"], ["1", "x"]], 3: [["a", "b"], ["c", "d"], ["1", "2"], ["3", "4"]], 4: [["1", "2"]],
        5: [["x"], ["Nhóm"], ["Ghi chú"], ["Mã"], ["Ngày"], ["1"]], 6: [["a"], ["(1)"], ["5"]], 7: [["", None], ["12", "13"]],
    }
    rows = [(t, n, cells) for t, lines in tables.items() for n, cells in enumerate(lines)]
    got = {r["t"]: r["header_rows"] for r in A.header_counts(spark.createDataFrame(rows, "t INT, n INT, c ARRAY<STRING>"), "t", "n", "c").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 4, 6: 2, 7: 1}
