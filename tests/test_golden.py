"""Expected values of single cases."""

import pytest

from quillon.operators import retrieval as R
from quillon.plans import catalog
from quillon.plans.fixtures import frame


def own(key):
    """Whether a key is that of a case as it stands, not dealt to a row of a given table."""
    return key < 1000 if isinstance(key, int) else "~" not in str(key)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return lambda name, key: {r[key]: r for r in catalog.queries()[name](spark, sf_dir).collect() if own(r[key])}


def test_hints(rows):
    got = rows("query_hints", "qid")
    for n in (1, 2, 3):
        assert (got[n]["type"], got[n]["number"], got[n]["asks_question"]) == ("Luật", "108", False)
    assert (got[4]["type"], got[4]["number"], got[4]["year"], got[4]["asks_question"]) == ("Thông tư", "89", "2026", False)
    assert got[5]["year"] == "2026" and got[6]["asks_question"] and got[6]["number"] is None and got[13]["injection"]


def test_question_plan(rows):
    got = rows("question_plan", "qid")
    assert "thuế giá trị gia tăng" in got[7]["areas"] and "hoàn thuế" in got[7]["intents"] and got[8]["clarify"] == "rate"


def test_time_intent_and_admission(rows, spark, sf_dir):
    got = {(r["qid"], r["doc"]): r for r in catalog.queries()["law_admission"](spark, sf_dir).collect()}
    assert [got[n, 1]["intent"] for n in (9, 10, 11, 12)] == ["current", "historical", "relationship", "future"]
    assert [got[9, d]["allowed"] for d in range(1, 7)] == [True, True, False, False, False, False]
    assert got[12, 3]["allowed"] and not got[12, 6]["allowed"] and got[10, 5]["allowed"]


def test_relevance(spark, sf_dir):
    got = {(r["qid"], r["cid"]): r["relevance"] for r in catalog.queries()["source_relevance"](spark, sf_dir).collect()}
    assert got[7, 3] < 1.4 and got[7, 2] >= 3


def test_grounding(rows):
    got = rows("answer_grounding", "aid")
    assert got[1]["unsupported"] and not got[2]["unsupported"] and not got[3]["unsupported"] and got[4]["missing_reference"]


def test_cross_check(spark):
    got = {r["gid"]: r for r in R.cross_check(frame(spark, "candidates"), frame(spark, "grounded")).collect()}
    assert [got[n]["outcome"] for n in range(1, 6)] == ["match", "match", "new", "conflict", "ignored"] and got[1]["score"] == pytest.approx(2.5 + 1.15)


def test_dates_and_conclusions(rows):
    days = rows("official_dates", "did")
    assert (days[1]["day"], days[2]["day"], days[3]["day"], days[7]["day"]) == ("2026-07-01", "2026-07-01", None, "2024-02-29")
    got = rows("conclusions", "rid")
    assert [got[n]["conclusion"] for n in range(1, 6)] == ["MATCH", "DATE", "AMOUNT", "BOTH", "MISSING"]


def test_tables(rows):
    assert [rows("header_mapping", "idx")[n]["source"] for n in range(3)] == [1, 0, -1]
    keys = rows("invoice_keys", "rid")
    assert keys[1]["dup_key"] == "0100111948 044|c24t|000123|23 06 2026" == keys[2]["dup_key"] and keys[3]["dup_key"] is None


def test_decisions(rows):
    got = rows("ingestion_decisions", "number")
    assert [got[k]["reason"] for k in "abcdefg"] == ["new", "ready", "processing", "retry_wait", "retry_due", "forced", "retry_due"]


def test_notifications(rows):
    got = rows("notification_classes", "revision")
    assert [got[f"r{n}"]["reason"] for n in range(1, 6)] == ["tax_title", "excluded_topic", "tax_content", "insufficient_tax_evidence", "tax_title"]
    assert got["r1"]["freshness"] == "fresh_document" and got["r2"]["freshness"] == "backfilled_full_text"


def test_selections_relations_and_updates(rows):
    got = rows("page_selections", "sid")
    assert [got[n]["pages"] for n in range(1, 6)] == ["1,2,3,7", "2,3,4,5,9", "4,5,6", "10", "1,3"]
    assert rows("update_relations", "target")["86/2024/NĐ-CP"]["kind"] == "replacement"
    assert rows("grouped_relations", "kind")["repeals"]["targets"] == "12/2020/TT-BTC,13/2020/TT-BTC"


def test_best_draft_prefers_consensus_within_the_tie(rows):
    got = rows("best_drafts", "page")
    assert (got[1]["pass"], got[2]["pass"], got[3]["pass"]) == ("consensus", "structure", "literal")


def test_validated_texts(rows):
    got = {n: r["warnings"] for n, r in rows("validated_texts", "case_id").items()}
    assert got[1] == "" and got[2] == "short,shell,number,date,structure,quality" and got[3] == "pages,page_score,unreadable,disagreement,order"
    assert got[4] == "" and got[5].startswith("structure,quality") and got[6] == "short,structure"


def test_legal_blocks(spark, sf_dir):
    got = {(r["doc"], r["first_line"]): (r["kind"], r["text"]) for r in catalog.queries()["clause_blocks"](spark, sf_dir).collect() if own(r["doc"])}
    assert got[1, 0] == ("heading", "Chương I QUY ĐỊNH CHUNG") and got[1, 2] == ("clause", "1. Phạm vi điều chỉnh")
    assert got[1, 4] == ("point", "a) 2. Người nộp thuế") and got[1, 6] == ("point", "đ) điểm đ tiếp theo") and got[1, 9] == ("paragraph", "đoạn văn") and got[1, 10] == ("paragraph", "chương ii")
    assert got[2, 0] == ("point", "- một gạch") and got[2, 4] == ("heading", "Mục 2 Tên") and len(got) == 8


def test_spoken_texts(rows):
    got = rows("spoken_texts", "tid")
    assert got[1]["speech"] == "STT, Nội dung ô đã đánh dấu Đồng ý, đã ký" and got[6]["control"] == "a\nb c ; d"
    assert got[2]["wrapper"] == "Điều 1. Phạm vi\n\n[KHÔNG ĐỌC RÕ] _______ hết." and got[5]["speech"] is None


def test_answers_and_keys(rows):
    got = rows("state_answers", "number")
    assert got["1/2026/TT-BTC"]["answer"] == "ready" and got["1/2026/TT-BTC"]["confidence"] == 0.99 and "6/2026/TT-BTC" not in got
    assert got["3/2026/TT-BTC"]["missing"] == "4–6, 9, 11–12" and got["4/2026/TT-BTC"]["missing"] == "1, 3, 5, 7, 9, 11, 13, 15, …"
    keys = {n: r["key"] for n, r in rows("header_invoice_keys", "sid").items()}
    assert keys == {1: "0101|1c26taa|00012|01 02 2026", 2: "||12|1 2 2026", 3: None, 4: None, 5: "|k|7|"}


def test_latest_updates(rows):
    got = rows("latest_updates", "target")
    assert got["A"]["source"] == "a2" and got["B"]["source"] == "b2" and "C" not in got


def test_ranges_across_spans(spark):
    from quillon.operators import etl

    numbers = [0, 1, 2, 3, 4, 7, 8, 9, 12, 15, 16, 17, -1, -2, -6]
    got = etl.ranges(spark.createDataFrame([("g", n) for n in numbers] + [("g", 3), ("g", None), (None, 5)], "g STRING, n INT"), "g", "n", 4).collect()
    assert sorted((r["first"], r["last"]) for r in got if r["g"]) == [(-6, -6), (-2, 4), (7, 9), (12, 12), (15, 17)] and [(r["first"], r["last"]) for r in got if r["g"] is None] == [(5, 5)]


def test_artifacts(spark):
    from quillon.operators import etl as E

    text = "SAO Y; Bộ Khoa học và Công nghệ; 02/04/2026; 17:08:02; +07:00\n5. NỘI DUNG HÓA ĐƠN LOGO\nNội dung pháp lý cần giữ.\nlogo LOGO, (LOGO) và WATERMARK mờ\nthời gian ký: 5\nSAO Y; không ngày\nCamScanner\n-----\n21"
    df = spark.createDataFrame([(1, text), (2, None), (3, "Ghi chú:\n4 Lựa chọn một (01)\n☐ Trách nhiệm")], "id INT, text STRING")
    got = {r["id"]: r for r in E.artifact_lines(df, "id", "text").collect()}
    assert got[1]["removed"] == 5 and got[1]["tokens"] == 5 and got[1]["flags"] == "certification_metadata,decorative_lines,logo_or_watermark,page_numbers,scanner_metadata"
    assert got[3]["removed"] == 0 and got[3]["tokens"] == 0 and got[3]["flags"] == ""
    lines = ["5. NỘI DUNG HÓA ĐƠN LOGO", "logo LOGO, (LOGO) và WATERMARK mờ", "LOGO", "logotype", "a -LOGO b"]
    cleaned = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x STRING").select(E.without_logos(E.F.col("x"))).collect()]
    assert cleaned == ["5. NỘI DUNG HÓA ĐƠN", ", ) và mờ", "", "logotype", "a b"]
