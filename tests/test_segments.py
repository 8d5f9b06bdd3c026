from pyspark.sql import functions as F

from quillon.functions import segments as G


def packed(pieces, limit):
    out = []
    for p in pieces:
        if out and len(out[-1]) + 1 + len(p) <= limit:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def test_pack_equals_a_loop(spark):
    words = [["a" * n for n in (3, 4, 90, 1, 1, 7, 30, 2)], [], ["x"]]
    rows = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "id INT, w ARRAY<STRING>")
    got = {r["id"]: r["p"] for r in rows.select("id", G.pack(F.col("w"), 10).alias("p")).collect()}
    assert got == {n: packed(w, 10) for n, w in enumerate(words)}


def test_speech_chunks_lose_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("text", G.speech_chunks(F.col("text")).alias("c")).collect()
    for r in rows:
        assert " ".join(r["c"]).split() == (r["text"] or "").split()
        assert all(len(x) <= 720 or " " not in x for x in r["c"])


def segmented(spark, make, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, t STRING")
    got = {r["n"]: r["c"] for r in rows.select("n", make(F.col("t")).alias("c")).collect()}
    return [got[n] for n in range(len(texts))]


def test_captions_keep_sentences_apart(spark):
    text = "Mức thuế tương ứng với doanh thu của từng ngành nghề kinh doanh theo quy định. Người nộp thuế tự kê khai."
    (got,) = segmented(spark, lambda t: G.captions(t, 80), [text])
    assert any(x.endswith("quy định.") for x in got) and got[-1] == "Người nộp thuế tự kê khai."
    # the last caption would be one word; it gets words until it has three and 34 characters
    words = ["abcdefghi"] * 12 + ["end."]
    plain, none, blank = segmented(spark, G.captions, [" ".join(words), None, "  "])
    assert none == blank == [] and plain == [" ".join(words[:9]), " ".join(words[9:])]


def test_evidence_chunks_overlap(spark):
    lines = [f"line {n} " + "x" * 90 for n in range(220)]
    got, long, short, none = segmented(spark, G.evidence_chunks, ["\n".join(lines), "y" * 8000, "a\nb", None])
    assert all(len(c) <= 3600 for c in got) and got[0].split("\n")[-4:] == got[1].split("\n")[:4]
    assert {x for c in got for x in c.split("\n")} == set(lines)
    assert max(map(len, long)) <= 3600 and len(long) == 3 and short == ["a\nb"] and none == []


def test_roles_of_blocks(spark):
    from quillon.operators.policies import block_roles

    blocks = ["CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "PHỤ LỤC I", "", "DANH MỤC BIỂU MẪU KÈM THEO", "(Kèm theo Nghị định)", "QUY ĐỊNH CHUNG VỀ THUẾ", "KT. BỘ TRƯỞNG", "", "Nguyễn Văn An", "Trần Thị Bình", "Nơi nhận:", "Lê Văn Cường", "just a text"]
    want = ["normal", "appendix-title", "normal", "appendix-note", "appendix-note", "section-title", "signature-role", "normal", "signer-name", "normal", "recipients", "normal", "normal"]
    df = spark.createDataFrame([(1, n, b) for n, b in enumerate(blocks)], "doc BIGINT, at INT, line STRING")
    got = {r["at"]: r["role"] for r in block_roles(df, "doc", "at", "line").collect()}
    assert [got[n] for n in range(len(blocks))] == want


def test_layouts_of_sheets(spark):
    from quillon.plans import layout

    got = {r["sheet"]: (r["header_start"], r["header_end"], r["data_start"]) for r in layout.cases(spark).collect()}
    assert got == {"report": (2, 2, 3), "grouped": (0, 1, 2)}


def test_numbers_and_articles_in_small_letters(spark):
    from quillon.functions import text as T
    from quillon.operators import etl, policies

    rows = spark.createDataFrame([("nghị định 15/2026/nđ-cp",), ("9/2026/qđ-ttg",)], "t STRING")
    assert [r[0] for r in rows.select(T.canonical_number(F.col("t"))).collect()] == ["15/2026/NĐ-CP", "9/2026/QĐ-TTG"]
    parts = etl.articles(spark.createDataFrame([(1, "Điều 1. Một\na\nđiều 2. Hai\nb\nĐIỀU 3. Ba\nc")], "d INT, t STRING"), "d", "t").where("kind = 'article'").collect()
    assert sorted(r["article"] for r in parts) == ["1", "2", "3"]
    asked = spark.createDataFrame([("thong tu 86 co con dung", "86/2024/tt-btc dang ky thue"), ("dang ky thue", "86/2024/tt-btc dang ky thue")], "q STRING, c STRING")
    assert [r[0] for r in asked.select(policies.disqualified(F.col("q"), F.col("c"))).collect()] == [False, True]
