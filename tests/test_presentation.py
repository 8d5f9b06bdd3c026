"""Documents cut for readers, and the fields of preambles: published cases and edge cases."""

import pytest

from quillon.operators import presentation as P

DOCS = {
    "signed": "BỘ TÀI CHÍNH\nSố: 82/2026/TT-BTC\nTHÔNG TƯ\nQuy định về kinh doanh hàng miễn thuế\n\nĐiều 10. Trách nhiệm thi hành\nCác đơn vị có trách nhiệm thi hành Thông tư này.\n\nĐiều 11. Điều khoản chuyển tiếp\n1. Doanh nghiệp tiếp tục hoạt động theo quy định.\n2. Việc thay đổi địa điểm thực hiện theo Thông tư này./. KT. BỘ TRƯỞNG\nTHỨ TRƯỞNG\nNguyễn Đức Chi\nPhụ lục (Kèm theo Thông tư số 82/2026/TT-BTC)\nMẫu số 01\nTÊN DOANH NGHIỆP",
    "appended": "THÔNG TƯ\nĐiều 1. Phạm vi\nNội dung chính.\n\nĐiều 2. Hiệu lực\nThông tư có hiệu lực từ ngày công bố.\nPHỤ LỤC I\nDANH MỤC BIỂU MẪU",
    "markdown": "BỘ TÀI CHÍNH\nTHÔNG TƯ\n\n**Điều 3. Giải thích từ ngữ** Trong Thông tư này, các từ ngữ dưới đây được hiểu như sau:\n1. Thông tin là thông tin về thuế.\n\nĐiều\n4. Nguyên tắc quản lý tuân thủ\nViệc quản lý được thực hiện.\n\nĐiều 5. Thu thập thông tin\nCơ quan thuế thu thập.",
    "inferred": "Điều 1\nPhạm vi điều chỉnh\nLuật này quy định về thuế.\nĐiều 2\nLuật này áp dụng cho mọi người.\nMột dòng nữa.\nĐiều 3\nNơi nhận:\n- Như trên",
    "plain": "không có điều nào", "empty": "", "null": None,
}


@pytest.fixture(scope="module")
def parts(spark):
    rows = P.parts(spark.createDataFrame(list(DOCS.items()), "id STRING, text STRING"), "id", "text").collect()
    return lambda name: [(r["kind"], r["identifier"], r["heading"], r["text"], r["order_index"]) for r in sorted(rows, key=lambda r: r["order_index"]) if r["id"] == name]


def test_signature_and_appendix_leave_the_last_article(parts):
    got = {p[1]: p for p in parts("signed")}
    assert list(got) == ["Phần mở đầu", "Điều 10", "Điều 11", "Phần ký và nơi nhận", "Phụ lục"] and [p[4] for p in parts("signed")] == [0, 100, 200, 300, 400]
    assert got["Điều 11"][3].endswith("theo Thông tư này./.") and got["Phần ký và nơi nhận"][3] == "KT. BỘ TRƯỞNG\nTHỨ TRƯỞNG\nNguyễn Đức Chi"
    assert got["Phụ lục"][3] == "Phụ lục (Kèm theo Thông tư số 82/2026/TT-BTC)\nMẫu số 01\nTÊN DOANH NGHIỆP"
    appended = {p[1]: p for p in parts("appended")}
    assert appended["Điều 2"][3] == "Thông tư có hiệu lực từ ngày công bố." and appended["Phụ lục"][3] == "PHỤ LỤC I\nDANH MỤC BIỂU MẪU" and "Phần ký và nơi nhận" not in appended


def test_headings(parts):
    got = {p[1]: p for p in parts("markdown")}
    assert got["Điều 3"][2] == "Giải thích từ ngữ" and got["Điều 3"][3].startswith("Trong Thông tư này") and got["Điều 4"][2] == "Nguyên tắc quản lý tuân thủ"
    inferred = {p[1]: p[2:4] for p in parts("inferred")}
    assert inferred["Điều 1"] == ("Phạm vi điều chỉnh", "Luật này quy định về thuế.") and inferred["Điều 2"] == ("Luật này áp dụng cho mọi người.", "Một dòng nữa.")
    assert inferred["Điều 3"] == (None, "") and inferred["Phần ký và nơi nhận"][1] == "Nơi nhận:\n- Như trên"
    assert parts("plain") == [("other", None, None, "không có điều nào", 0)] and parts("empty") == parts("null") == []


PREAMBLES = {
    1: "CHÍNH PHỦ ______\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\nSố: 141/2026/NĐ-CP CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM Độc lập - Tự do - Hạnh phúc\nHà Nội, ngày 29 tháng 4 năm 2026\nNGHỊ ĐỊNH Sửa đổi, bổ sung một số điều của Nghị định số 68/2026/NĐ-CP của Chính phủ\nCăn cứ Luật Tổ chức Chính phủ số 63/2025/QH15; Căn cứ Luật Thuế thu nhập cá nhân số 109/2025/QH15; Theo đề nghị của Bộ trưởng Bộ Tài chính;",
    2: "VĂN BẢN QUY PHẠM PHÁP LUẬT\nCHÍNH PHỦ\nCHÍNH PHỦ\nSố: 67/2025/NĐ-CP CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM Độc lập - Tự do - Hạnh phúc\nHà Nội, ngày 15 tháng 3 năm 2025\nNGHỊ ĐỊNH VỀ SỬA ĐỔI, BỔ SUNG MỘT SỐ ĐIỀU CỦA NGHỊ ĐỊNH SỐ 178/2024/NĐ-CP CỦA CHÍNH PHỦ\nCăn cứ Luật Tổ chức Chính phủ ngày 18 tháng 02 năm 2025; Theo đề nghị của Bộ trưởng Bộ Nội vụ;",
    3: "BỘ TÀI CHÍNH\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\nSố: 89/2026/TT-BTC\nHà Nội, ngày 30 tháng 6 năm 2026\nTHÔNG TƯ\nQuy định chi tiết một số điều của Nghị định số 252/2026/NĐ-CP của Chính phủ\nCăn cứ Luật Quản lý thuế;",
    4: "BỘ TÀI CHÍNH\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\nSố: 89/2026/TT-BTC\nHà Nội, ngày 30 tháng 6 năm 2026\nQuy định chi tiết một số điều của Nghị định số 252/2026/NĐ-CP của Chính phủ\nCăn cứ Luật Quản lý thuế;",
    5: "SỞ XÂY DỰNG\nCHỈ THỊ\nVề an toàn", 6: "", 7: None, 8: "Căn cứ Luật Đất đai;",
}


def test_preambles(spark):
    got = {r["id"]: r for r in P.preamble(spark.createDataFrame(list(PREAMBLES.items()), "id INT, text STRING"), "id", "text").collect()}
    assert (got[1]["authority"], got[1]["number"], got[1]["dateline"], got[1]["type"]) == ("CHÍNH PHỦ", "Số: 141/2026/NĐ-CP", "Hà Nội, ngày 29 tháng 4 năm 2026", "NGHỊ ĐỊNH")
    assert got[1]["title"] == "Sửa đổi, bổ sung một số điều của Nghị định số 68/2026/NĐ-CP của Chính phủ" and len(got[1]["grounds"]) == 3 and sum(g.startswith("Căn cứ") for g in got[1]["grounds"]) == 2
    assert got[2]["authority"] == "CHÍNH PHỦ" and got[2]["type"] == "NGHỊ ĐỊNH" and "CỦA CHÍNH PHỦ" in got[2]["title"] and "PHÁP LUẬT" not in got[2]["title"]
    assert got[3]["authority"] == "BỘ TÀI CHÍNH" and got[3]["type"] == "THÔNG TƯ" and got[3]["title"] == "Quy định chi tiết một số điều của Nghị định số 252/2026/NĐ-CP của Chính phủ"
    assert got[4]["type"] == "THÔNG TƯ" and got[4]["title"] == got[3]["title"]
    assert (got[5]["authority"], got[5]["number"], got[5]["dateline"], got[5]["type"], got[5]["title"]) == ("SỞ XÂY DỰNG", None, None, "CHỈ THỊ", "Về an toàn") and 6 not in got and 7 not in got
    assert got[8]["grounds"] == ["Căn cứ Luật Đất đai;"] and got[8]["authority"] == "CƠ QUAN BAN HÀNH" and got[8]["type"] == "VĂN BẢN"


def test_blocks_are_in_order(spark):
    rows = P.preamble_blocks(spark.createDataFrame([(1, PREAMBLES[1])], "id INT, text STRING"), "id", "text").orderBy("place").collect()
    assert [r["kind"] for r in rows] == [*[f"preamble-{k}" for k in ("authority", "nation", "motto", "number", "dateline", "type", "title")], "paragraph", "paragraph", "paragraph"]


def test_pages_of_the_middle_have_no_preamble(spark):
    pages = spark.createDataFrame([(1, 8, "tiếp.\nĐiều 5. Năm\nsau"), (1, 7, "của điều trước\nĐiều 4. Bốn\nnội dung"), (2, 1, "BỘ TÀI CHÍNH\nĐiều 1. Một\nx"), (3, 2, None), (4, 3, "không có điều")], "d INT, p INT, t STRING")
    got = {(r["d"], r["order_index"]): (r["kind"], r["identifier"], r["text"]) for r in P.main_provisions(pages, "d", "p", "t").collect()}
    assert got == {
        (1, 0): ("continuation", "Nội dung tiếp theo · Trang 7", "của điều trước"), (1, 100): ("article", "Điều 4", "nội dung\ntiếp."), (1, 200): ("article", "Điều 5", "sau"),
        (2, 0): ("preamble", "Phần mở đầu", "BỘ TÀI CHÍNH"), (2, 100): ("article", "Điều 1", "x"), (4, 0): ("other", None, "không có điều"),
    }
