"""Listings, article bodies and transcripts against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import listings as L
from quillon.plans import catalog
from test_golden import own


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return lambda name, *keys: {tuple(r[k] for k in keys): r for r in catalog.queries()[name](spark, sf_dir).collect() if own(r[keys[0]])}


def test_references(rows):
    got = {k[0]: r["decoded"] for k, r in rows("reference_cases", "rid").items()}
    assert got == {1: 'a &lt; b Điều "x"  |', 2: "&unknown; &#0; &#xD800; &#1114112; 😀", 3: "", 4: None, 5: "&#39; &lt; &apos"}


def test_listings(rows):
    got = rows("listed_documents", "page", "rank")
    assert [got[1, n]["number"] for n in (1, 2, 3)] == ["89/2026/TT-BTC", "12/2026/QH15", "15/2026/QĐ-TTg"] and len(got) == 5
    assert got[1, 2]["url"] == "https://chinhphu.vn/x?docId=4" and got[1, 2]["issuer"] == "Quốc hội"
    found = rows("found_documents", "page", "rank")
    assert [found[k]["score"] for k in ((1, 1), (1, 2), (3, 1))] == [4.8, 0.65, 1.8]


def test_windows_equal_slices(spark):
    html = "".join(f"<p>{'x' * n}</p><a href='/?docid={n}'>n{n}</a>" for n in range(40))
    got = L.document_links(spark.createDataFrame([(1, html)], "page INT, html STRING"), "page", "html", "https://a.chinhphu.vn/", 30, 20).orderBy("at").collect()
    for r in got:
        link = f"<a href='/?docid={r['at']}'>n{r['at']}</a>"
        at = html.index(link)
        want = spark.range(1).select(L.bare_text(F.lit(html[max(0, at - 30):at + len(link) + 20]))).first()[0] if r["at"] in (0, 7, 39) else r["around"]
        assert r["around"] == want and r["anchor"] == f"n{r['at']}"
    assert len(got) == 40


def test_article_bodies(spark, rows):
    got = rows("article_bodies", "page")
    assert set(got) == {(1,), (2,), (5,)} and got[1,]["text"] == 'Thông tư 89/2026/TT-BTC\nĐiều 1. "Phạm vi"\\\nĐiều 2. Đối tượng'
    assert got[2,]["text"] == "hai\nba\nNghị định 70/2025/nđ-cp\nChương I\n1. Khoản" and got[5,]["source"] == 2 and not got[5,]["usable"]
    body = "Nghị định 7/2026/NĐ-CP\n" + "".join(f'Điều {n}. "{n}"\\\n' for n in range(1, 6000))  # long, with an escape in each line
    page = "<script>" + json.dumps({"x": 1, "articleBody": body}, ensure_ascii=False) + "</script>"
    long = L.article_bodies(spark.createDataFrame([(1, "7/2026/NĐ-CP", page), (2, "17/2026/NĐ-CP", page), (3, "7/2026/NĐ-CP", "")], "page INT, number STRING, html STRING"), "page", "html", "number").collect()
    assert len(long) == 1 and long[0]["text"] == body.strip() and long[0]["usable"]


def test_transcripts_and_texts(rows):
    got = {k[0]: r["warnings"] for k, r in rows("accepted_transcripts", "tid").items()}
    assert got == {1: "", 2: "broken_end,short,score,page_marks,structure", 3: "unread", 4: "structure", 5: ""}
    texts = {k[0]: r["text"] for k, r in rows("legal_markdown", "mid").items()}
    assert texts[1] == "Điều 3. Giải thích từ ngữ\nTrong Nghị định này\nChương I\nĐiều 4. Phạm vi" and texts[3] == "MỤC II: Tên mục" and texts[5] is None
    assert [rows("best_by_method", "number")[k,]["did"] for k in "ABC"] == [3, 5, 7]


def test_titles_and_days(spark):
    from pyspark.sql import functions as F

    from quillon.operators import listings as L

    rows = [
        ("Thông tư hướng dẫn hóa đơn", "x 89/2026/TT-BTC y", "89/2026/TT-BTC"), ("Thông tư 89/2026/TT-BTC", "Số 89/2026/TT-BTC Hướng dẫn thuế Ngày ban hành: 30/06/2026 Ngày có hiệu lực 01.07.2026", "89/2026/TT-BTC"),
        ("", "12/2026/QH15 Ngày ban hành 31/02/2026", "12/2026/QH15"), ("", "trước 5/1/2026 12/2026/QH15", "12/2026/QH15"),
    ]
    df = spark.createDataFrame(rows, "a STRING, t STRING, n STRING")
    got = df.select(L.listed_title(F.col("a"), F.col("t"), F.col("n")).alias("title"), L.listed_day(F.col("t"), L.ISSUED).alias("issued"), L.listed_day(F.col("t"), L.EFFECTIVE).alias("effective"), L.listed_day(F.col("t")).alias("first")).collect()
    assert [r["title"] for r in got] == ["Thông tư hướng dẫn hóa đơn", "Hướng dẫn thuế", "Văn bản số 12/2026/QH15", "Văn bản số 12/2026/QH15"]
    assert [(r["issued"], r["effective"], r["first"]) for r in got] == [(None, None, None), ("2026-06-30", "2026-07-01", "2026-06-30"), (None, None, None), (None, None, "2026-01-05")]
