"""Blocks, and tables and paragraphs across pages: published cases and edge cases."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks as B
from quillon.operators import stitching as S

PAGES = {
    "forms": "PHỤ LỤC\n| Mẫu số 01 | Đơn đề nghị thẩm định công nghệ |\n| Mẫu số 02 | Thuyết minh công nghệ đề nghị thẩm định |\n| Mẫu số 03 | Thông báo dự toán kinh phí |",
    "council": "| STT | Họ và tên | Lĩnh vực chuyên môn/quản lý | Cơ quan công tác | Chức danh trong Hội đồng |\n| :--- | :--- | :--- | :--- | :--- |\n| 1 | | | | Chủ tịch |\n| 2 | | | | Phó Chủ tịch |\n| 3 | | | | Ủy viên |",
    "wrapped": "| STT | Nội dung tiêu chí | Đạt | Không đạt | Nhận xét/đánh giá |\nYêu cầu giải trình/bổ sung (nếu có) | :--- | :--- | :--- | :--- | :--- | :--- |\n| 1 | Có phương án được mô tả rõ ràng □ □ |\n| 2 | Có một hoặc một số yếu tố kỹ thuật □ □ |",
    "fragments": "| STT | Nội dung tiêu chí | Đạt | Không đạt |\n| 1 | Có phương án, giải pháp kỹ thuật |\n| 1 | được mô tả rõ ràng | □ | □ |\n| 2 | Có khả năng tạo ra sản phẩm | □ | □ |",
    "notice": "THÔNG BÁO\nVề ....................................\n... ... ... ... ... ... ... ...\n........................................\nKính gửi: ..............................\n1. Dự toán kinh phí",
    "boxes": "I. THÔNG TIN TỔ CHỨC, CÁ NHÂN\n1. Tên tổ chức/cá nhân: ..........................\n□ Công nghệ do tổ chức tạo ra\n☑ Công nghệ đã được lựa chọn",
    "tagged": "[TABLE]\n| STT | Nội dung |\n| 1 | dòng đầu |\nđược nối vào ô cuối\n.....\n| 2 | dòng hai |\n[/TABLE]\nsau bảng",
    "form rows": "Mẫu số 1 Đơn\nMẫu số 02: Thông báo\nMẫu số 3\nhết.",
    "single": "| một | hai |\ncâu một\ntiếp theo.\nCâu hai\ncâu hai\nb) điểm\nĐiều 5. Hiệu lực\nGhi chú: xem\nCHƯƠNG II\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM",
    "empty": "", "null": None, "unclosed": "[TABLE]\nmột dòng\nhai dòng",
}


@pytest.fixture(scope="module")
def blocks(spark):
    rows = B.build_blocks(spark.createDataFrame(list(PAGES.items()), "id STRING, text STRING"), "id", "text").collect()
    return lambda name: sorted((r for r in rows if r["id"] == name), key=lambda r: r["place"])


def tables(rows):
    return [r for r in rows if r["kind"] == "table"]


def test_published_tables(blocks):
    (forms,) = tables(blocks("forms"))
    assert (forms["columns"], forms["header_rows"], forms["first_column"], len(forms["rows"])) == (2, 0, "label", 3) and forms["rows"][1] == ["Mẫu số 02", "Thuyết minh công nghệ đề nghị thẩm định"]
    (council,) = tables(blocks("council"))
    assert (council["columns"], council["header_rows"], council["first_column"]) == (5, 1, "index") and council["rows"][1] == ["1", "", "", "", "Chủ tịch"]
    (wrapped,) = tables(blocks("wrapped"))
    assert wrapped["columns"] == 6 and wrapped["rows"][0][5] == "Yêu cầu giải trình/bổ sung (nếu có)" and wrapped["rows"][1][1:4] == ["Có phương án được mô tả rõ ràng", "□", "□"]
    (fragments,) = tables(blocks("fragments"))
    assert fragments["rows"][1] == ["1", "Có phương án, giải pháp kỹ thuật được mô tả rõ ràng", "□", "□"] and len(fragments["rows"]) == 3


def test_published_lines(blocks):
    notice = blocks("notice")
    assert [r["kind"] for r in notice] == ["title", "field", "heading"] and notice[1]["mark"] == "Kính gửi:" and notice[1]["value"] == ""
    assert [(r["kind"], r["checked"]) for r in blocks("boxes")] == [("heading", None), ("field", None), ("checkbox", False), ("checkbox", True)]


def test_other_lines(blocks):
    (tagged,) = tables(blocks("tagged"))
    assert tagged["rows"] == [["STT", "Nội dung"], ["1", "dòng đầu được nối vào ô cuối"], ["2", "dòng hai"]] and [r["kind"] for r in blocks("tagged")] == ["table", "paragraph"]
    forms = blocks("form rows")
    assert forms[0]["rows"] == [["Mẫu số 01", "Đơn"], ["Mẫu số 02", "Thông báo"]] and [r["kind"] for r in forms] == ["table", "heading", "paragraph"]
    single = [(r["kind"], r["text"]) for r in blocks("single")]
    assert single == [
        ("paragraph", "một | hai câu một tiếp theo."), ("paragraph", "Câu hai"), ("list", "điểm"), ("article", "Điều 5. Hiệu lực"), ("note", "Ghi chú: xem"), ("heading", "CHƯƠNG II"),
        ("title", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM")]
    assert blocks("empty") == blocks("null") == [] and [r["text"] for r in blocks("unclosed")] == ["[TABLE] một dòng hai dòng"]


def stitched(spark, pages):
    blocks = S.page_blocks(spark.createDataFrame(pages, "d INT, p INT, t STRING"), "d", "p", "t")
    return sorted(S.stitched_tables(blocks).collect(), key=lambda r: (r["doc"], r["table"])), S.stitched_paragraphs(blocks).collect()


HEAD = "| STT | Nội dung tiêu chí | Đạt | Không đạt |\n| :--- | :--- | :--- | :--- |\n"


def test_tables_over_three_pages(spark):
    got, _ = stitched(spark, [
        (1, 20, HEAD + "| 1 | Tiêu chí một | □ | □ |\n| 2 | Nội dung bị cắt ở cuối trang |"), (1, 21, "| 2 | và được nối ở đầu trang sau | ☑ | □ |\n| 3 | Tiêu chí ba □ ☑ |"),
        (1, 22, "với phần còn lại của tiêu chí ba\n| 4 | Tiêu chí bốn □ |\n| 5 | Tiêu chí năm | □ | □ |"), (2, 12, HEAD + "| 1 | một | □ | □ |"), (2, 13, HEAD + "| 2 | hai | ☑ | □ |"),
    ])
    assert got[0]["rows"][1:] == [["1", "Tiêu chí một", "□", "□"], ["2", "Nội dung bị cắt ở cuối trang và được nối ở đầu trang sau", "☑", "□"], ["3", "Tiêu chí ba với phần còn lại của tiêu chí ba", "□", "☑"], ["4", "Tiêu chí bốn", "□", ""], ["5", "Tiêu chí năm", "□", "□"]]
    assert (got[0]["first_page"], got[0]["last_page"], got[0]["parts"], got[0]["cut_rows"], got[0]["unclear_rows"]) == (20, 22, 3, 1, 1)
    assert got[1]["rows"][1:] == [["1", "một", "□", "□"], ["2", "hai", "☑", "□"]] and got[1]["parts"] == 2 and len(got) == 2


def test_pages_apart_and_other_tables_stay_apart(spark):
    got, _ = stitched(spark, [
        (1, 2, HEAD + "| 1 | một | □ | □ |"), (1, 9, "| 2 | bảng khác | □ | □ |\n| 3 | hàng | □ | □ |"), (2, 1, HEAD + "| 1 | một | □ | □ |"), (2, 2, "| STT | Họ và tên | Lĩnh vực | Chức danh |\n| 1 | A | B | C |"), (2, 3, "| a | b |\n| c | d |"), (3, 1, None), (3, 2, ""),
    ])
    assert [(r["doc"], r["first_page"], r["parts"]) for r in got] == [(1, 2, 1), (1, 9, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1)]


def test_bands_of_a_page_are_one_table(spark):
    got, _ = stitched(spark, [(1, 7, HEAD + "| 1 | Tiêu chí một | □ | □ |\n| 2 | Tiêu chí hai | □ | □ |\nvà phần nối\n| 3 | Tiêu chí ba □ □ |\n| 4 | Tiêu chí bốn □ □ |\nHết.\n| 5 | khác | □ | □ |\n| 6 | nữa | □ | □ |")])
    assert [len(r["rows"]) for r in got] == [5, 2] and got[0]["rows"][2] == ["2", "Tiêu chí hai và phần nối", "□", "□"] and got[0]["rows"][4] == ["4", "Tiêu chí bốn", "□", "□"]


def test_paragraphs_over_pages(spark):
    _, got = stitched(spark, [(1, 1, "Điều 1. Một\nđoạn văn bắt đầu"), (1, 2, "đi qua cả trang"), (1, 3, "rồi mới kết thúc. \nĐoạn khác"), (1, 5, "không liền trang"), (2, 1, "đã hết."), (2, 2, "đoạn mới")])
    assert [(r["doc"], r["first_page"], r["last_page"], r["text"]) for r in got] == [(1, 1, 3, "đoạn văn bắt đầu đi qua cả trang rồi mới kết thúc.")]


def test_unions_of_keyed_frames_stay_sound(spark):
    """The session setting that the plans rely on: rows of a key meet in one group behind a union."""
    from quillon.functions.session import sound_unions

    sound_unions(spark)
    rows = spark.range(2000).select((F.col("id") % 50).alias("k"), "id").groupBy("k", "id").count()
    both = rows.where("id % 2 = 0").unionByName(rows.where("id % 2 = 1")).groupBy("k").count()
    assert both.count() == 50
