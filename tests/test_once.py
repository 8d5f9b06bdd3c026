"""What is asked of a text is taken from it before it meets queries or is shuffled: above a join no plan reads a text again."""

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import policies as P
from quillon.operators import publishing, state
from quillon.operators import retrieval as R
from quillon.operators.etl import classify_notifications as classify
from quillon.plans import etl, listings, merging, policies, retrieval
from quillon.plans import publishing as plans
from quillon.plans import state as state_plans


def above_joins(df):
    """The optimised plan down to its last join, in small letters."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().lower().split("\n")
    joins = [n for n, line in enumerate(lines) if "join " in line]
    return "\n".join(lines[: joins[0] + 1])


def test_candidates_are_judged_before_they_meet_questions(spark, sf_dir):
    found = above_joins(policies.disqualified_sources(spark, sf_dir))
    assert "join " in found and "rlike" not in found and "regexp" not in found
    asked = spark.createDataFrame([(None, "bai bo toan bo"), ("bai bo", None), ("cong ty", "ho kinh doanh"), ("thue", "86 / 2024 / tt-btc"), ("86/2024", "86/2024/tt-btc")], "q STRING, c STRING")
    got = asked.select(P.unfit(P.asked_of(F.col("q")), P.held_by(F.col("c"))).alias("a"), P.disqualified(F.col("q"), F.col("c")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [None, False, True, True, False]


def test_phrases_are_words(spark):
    pattern = r"\b(?:thue suat|muc thue)\b"
    rows = spark.createDataFrame([("thue suat",), ("muc thue nao",), ("xthue suat",), ("thue suatx",), ("",), (None,), ("muc thuex muc thue",)], "t STRING")
    assert [tuple(r) for r in rows.select(T.says(F.col("t"), pattern), F.col("t").rlike(pattern)).collect()] == [(x, x) for x in (True, True, False, False, False, None, True)]
    assert "contains" in rows.select(T.says(F.col("t"), pattern))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_relevance_reads_no_text_for_a_pair(spark, sf_dir):
    for query in (merging.relevant_sources, retrieval.source_relevance):
        found = above_joins(query(spark, sf_dir))
        assert "join " in found and "rlike" not in found and "regexp" not in found and "split" not in found
    for query in (retrieval.lexical_relevance,):
        assert "rlike(c#" not in above_joins(query(spark, sf_dir)).replace(" rlike", "rlike")


def test_relevance_of_many_queries_equals_that_of_few(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "Thuế suất hoàn thuế bao nhiêu?"), (2, "Công ty nộp thuế thế nào"), (3, "")], "qid INT, query STRING")
    held = spark.createDataFrame([(1, "thuế suất hoàn thuế"), (2, "hộ kinh doanh nộp thuế"), (3, ""), (4, None)], "cid INT, body STRING")
    rows = lambda f: sorted(map(str, f(asked, held).collect()))
    few = [rows(f) for f in (R.source_relevance, R.lexical_relevance)]
    monkeypatch.setattr(R, "BLOCK", 1)
    assert [rows(f) for f in (R.source_relevance, R.lexical_relevance)] == few and all(few)


def test_texts_are_compacted_once(spark, sf_dir):
    found = above_joins(retrieval.update_relations(spark, sf_dir))
    assert "join " in found and "translate" not in found
    texts = ["86/2024/NĐ-CP", "thay thế 8 6 / 2 0 2 4 /\n n đ - c p", "86/2024", "8 7/2024", "86/1/2024/NĐ-CP", "８６/2024/NĐ-CP", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = rows.select(R.may_name(F.col("t"), ["86/2024/NĐ-CP", "1/2020/X"]), F.contains(R.compacted(F.col("t")), F.lit("86/2024/nd-cp")), R.relation_kind(F.lit("86/2024/NĐ-CP"), F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False, None] and [r[1] for r in got] == [True, True, False, False, False, False, False, None]
    assert [r[2] for r in got] == [None, "replacement", *[None] * 6]


def test_long_texts_are_checked_by_their_folded_prefixes(spark):
    texts = ["Điều Σ" * 9_000, "é" * 20_000 + " 89/2026", "á" * 25_000 + "89 / 2026", "x" * 12_001, "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", T.fold(F.left("t", F.lit(30_000))).alias("whole"))
    for n in (12_000, 20_000):
        got = rows.select(publishing.folded_prefix(F.col("t"), F.col("whole"), n).alias("a"), T.fold(F.left("t", F.lit(n))).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]


def test_texts_are_checked_before_they_are_joined(spark, sf_dir):
    found = above_joins(plans.validated_texts(spark, sf_dir))
    assert "join " in found and "translate" not in found and "regexp" not in found
    plan = plans.usable_drafts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("translate(") <= 4


def test_type_words_are_searched_one_by_one(spark, sf_dir):
    for query in (plans.validated_texts, plans.usable_drafts):
        assert "(?:^|[^A-Za-z0-9_])" not in query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    texts = ["LUẬT", "xLUẬT", "LUẬT_", "a LUẬT\n", "xLUẬT LUẬT.", "THÔNG TƯ", "THÔNG TƯ số", "THÔNG TƯ1", "ÔTHÔNG TƯs", "xTHÔNG TƯs", "QUYẾT ĐỊNH", "NGHỊ ĐỊNHĐ", "😀LUẬT😀", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for words, pattern in ((publishing.GATE_WORDS, publishing.GATE_TYPES), (publishing.LEGAL_WORDS, publishing.LEGAL_TYPES)):
        got = rows.select(publishing.has_type(F.col("t"), words).alias("a"), F.col("t").rlike(pattern).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got] and any(r["a"] for r in got)


def test_white_space_is_taken_off_without_searching_the_text(spark):
    texts = [a + b + c for a in ("", " ", "\n\xa0", "\x85", "\ufeff \u2028") for b in ("", "x", "x  y\t\nz \r\n w\xa0 \u2003v", "\x85") for c in ("", " ", " \x85", "\r\n", "\xa0\x0b\u2029", " \x85 ", "\u2003")]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t STRING")
    ends, space = f"^{T.JS_SPACE}+|{T.JS_SPACE}+$", r"[\s\xa0]+"
    got = rows.select(T.strip(F.col("t")), F.regexp_replace("t", ends, ""), T.squeeze(F.col("t")), F.trim(F.regexp_replace("t", space, " ")), T.unspaced(F.col("t")), F.regexp_replace("t", space, "")).collect()
    assert [(r[0], r[2], r[4]) for r in got] == [(r[1], r[3], r[5]) for r in got]
    for made, pattern in ((T.squeeze, "\\s"), (T.unspaced, "\\s")):
        assert pattern not in rows.select(made(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "btrim(" in rows.select(T.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_texts_without_structure_are_not_folded(spark, sf_dir):
    portal = "English 中文 Trang  chủ\nChính phủ Lai\tChâu Điện Biên "
    heads = ["Điều 1. A\nĐiều 2. B\n89 / 2026\n", portal + "\nĐiều 1. A\nMục 2\n", "Σ\u0301" + portal + "\nĐiều 1. A\nMục 2\n89/2026", "89/2026", "LUẬT 8 9/2026 ", "LUẬT Trang Chu Chinh Phu Lai Chau Dien Bien Tuyen Quang nuoc chxhcn viet nam 89/2026"]
    cases = [(h + body * n, e) for h in heads for body, n in (("x ", 100), ("x ", 500), ("é  y\n", 1500), ("z" * 13_000 + " " + portal, 1)) for e in ("89/2026", "", None)] + [(None, "89/2026"), ("", None)]
    rows = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "id INT, text STRING, expected STRING")
    got = {r["id"]: r["usable"] for r in publishing.usable_texts(rows, "id", F.col("text"), "expected").collect()}
    want = {r["id"]: r["usable"] for r in rows.select("id", publishing.usable_text(F.col("text"), F.col("expected")).alias("usable")).collect()}
    assert got == want and len(set(got.values())) == 2
    lines = plans.usable_drafts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    folded = [line for line in lines if "Generate explode" in line and "translate(" in line]
    assert folded and all("CASE WHEN" in line and "Chương" in line for line in folded)


def test_due_counts_equal_the_pairs(spark, sf_dir):
    notices = spark.createDataFrame([(1, 1, 5.0), (2, 1, 0.0), (3, 2, 9.0), (4, None, 9.0), (5, 1, None), (6, 1, 5.0), (6, 1, 7.0)], "notice INT, topic INT, published DOUBLE")
    readers = spark.createDataFrame([(1, 1, 5.0), (2, 1, 4.0), (3, 1, 6.0), (4, 2, 9.5), (5, None, 1.0), (6, 1, None), (7, 1, 5.0)], "subscriber INT, topic INT, subscribed DOUBLE")
    none = spark.createDataFrame([], "notice INT, subscriber INT")
    pairs = state.pending_deliveries(notices, readers, none).groupBy("notice").agg(F.count(F.lit(1)).alias("due"))
    rows = lambda df: sorted((r["notice"], r["due"]) for r in df.collect())
    assert rows(state.due_counts(notices, readers)) == rows(pairs) == [(1, 3), (6, 7)]
    assert "join" not in state_plans.deliveries(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_texts_are_measured_before_they_are_grouped(spark, sf_dir):
    lines = listings.best_by_method(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower().split("\n")
    assert "aggregate" in lines[0] and "text" not in lines[0] and "text" not in lines[1]


def test_titles_and_bodies_are_normalised_once(spark, sf_dir):
    for query in (plans.notify_window, etl.notification_classes):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert not [line for line in plan.split("\n") if "filter(" in line and "lambdafunction(contains(trim" in line]
    rows = [("r1", "Biên chế thuế", "x"), ("r2", "Thuế", None), ("r3", "Nghị định", "hóa đơn; cơ quan thuế; nghĩa vụ thuế"), ("r4", None, None)]
    docs = spark.createDataFrame([(*r, None, None, "bad") for r in rows], "revision STRING, title STRING, body STRING, kind STRING, issued STRING, published STRING")
    assert [r["reason"] for r in classify(docs).orderBy("revision").collect()][1:2] == ["tax_title"]


def test_rows_are_told_with_few_searches(spark):
    from quillon.operators import speech as A

    header = F.array(*map(F.lit, ["STT", "Nội dung", "Đạt", "Khác"]))
    rows = spark.createDataFrame([(1, ["1", "đơn , a", "☑", "x"]), (2, ["", None, "□", ""]), (3, []), (4, ["2", "b", "", "", "thừa"])], "id INT, cells ARRAY<STRING>")
    told = rows.select(A.told_row(header, F.col("cells")).alias("t"))
    assert [r["t"] for r in told.collect()] == ["Mục 1. đơn, a. Đã chọn Đạt. x.", "", "", "Mục 2. b. thừa."]
    # what is said of number, content and rest: three chains of rules, not one for each place that reads them
    assert told._jdf.queryExecution().optimizedPlan().toString().count("ô đã đánh dấu") == 3


def test_unlike_sizes_need_no_comparison(spark):
    from quillon.operators import selection as C

    lines = spark.createDataFrame([(["một hai ba bốn", "một hai ba bốn năm", "một", "x", "y z", "MỘT hai ba bon", "một hai sáu bảy"],), ([],)], "l ARRAY<STRING>")
    kept = lines.select(C.greedy_distinct(F.col("l"), 0.72).alias("k"))
    assert [r["k"] for r in kept.collect()] == [["một hai ba bốn", "một", "x", "một hai sáu bảy"], []]
    assert "array_union" not in kept._jdf.queryExecution().optimizedPlan().toString().lower()


def test_kinds_of_lines_are_found_once(spark, tmp_path):
    from quillon.operators import blocks as B

    docs = spark.createDataFrame([(1, "Điều 1. A\n| a | b |\n| c | d |\nđoạn\nvăn."), (2, None)], "id INT, text STRING")
    found = B.build_blocks(docs, "id", "text", f"file://{tmp_path}")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "THÔNG TƯ" not in plan and "regexp_extract" not in plan  # kinds and tables are read, not found again
    assert sorted(map(str, found.collect())) == sorted(map(str, B.build_blocks(docs, "id", "text").collect()))


def test_blocks_are_written_and_shuffled_once(spark, tmp_path):
    from quillon.operators import presentation as A

    text = "m\nĐiều 1. A\n| a | b |\n| c | d |\nđoạn\nvăn.\nMẫu số 1: x\nMẫu số 2: y\nĐiều 2. B\n[TABLE]\n| a | b |\n| c | d |\nthêm\n[/TABLE]"
    docs = spark.createDataFrame([(1, text), (None, text), (3, None)], "id INT, text STRING")
    found = A.reader_items(docs, "id", "text", f"file://{tmp_path}/x")
    assert not (tmp_path / "x" / "parts").exists() and all("zstd" in f.name for f in (tmp_path / "x").rglob("*.parquet"))
    lines = spark.read.parquet(f"file://{tmp_path}/x/lines").collect()
    said = [(r["line"] is not None) + (r["cells"] is not None) + (r["k"] is not None) for r in lines]
    assert max(said) == 1 and {r["line"] for r in lines if r["line"]} == {"Mẫu số 1: x", "Mẫu số 2: y", "thêm", "[TABLE]", "[/TABLE]"}
    assert sorted(map(str, found.collect())) == sorted(map(str, A.reader_items(docs, "id", "text").collect()))
    got = {(r["order_index"], r["place"]): (r["identifier"], r["kind"], r["rows"]) for r in found.where("id IS NULL").collect()}
    assert got[100, 1] == ("Điều 1", "table", [["a", "b"], ["c", "d"]]) and got[300, 3] == (A.APPENDED, "table", [["a", "b"], ["c", "d thêm"]]) and got[0, 1][1] == "paragraph" and len(got) == 6
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = A.reader_items(docs, "id", "text", f"file://{tmp_path}/y")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert plan.count("Exchange hashpartitioning") == 3  # of paragraphs, of all blocks, of what is said of parts


def test_parts_are_found_with_few_searches(spark, sf_dir):
    from quillon.operators import presentation as A
    from quillon.plans import presentation

    plan = presentation.presented_parts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("DANH\\s+MỤC") == 3  # where the tail begins, whether it begins with an appendix, where that begins else
    docs = spark.createDataFrame([(1, "Điều 1. A\nx ./. BỘ TRƯỞNG\nPHỤ LỤC I\ny"), (2, "m\nĐiều 1.\nĐầu đề ngắn\nnội dung\nNơi nhận: z"), (3, "PHỤ LỤC\nĐiều 2. B\nPHỤ LỤC (Kèm theo"), (4, None)], "id INT, text STRING")
    got = A.parts(docs, "id", "text").orderBy("id", "order_index").collect()
    assert [(r["id"], r["heading"] or r["identifier"], r["text"]) for r in got] == [
        (1, "A", "x ./."), (1, A.SIGNED, "BỘ TRƯỞNG"), (1, A.APPENDED, "PHỤ LỤC I\ny"), (2, A.OPENING, "m"), (2, "Đầu đề ngắn", "nội dung"), (2, A.SIGNED, "Nơi nhận: z"),
        (3, A.OPENING, "PHỤ LỤC"), (3, "B", ""), (3, A.APPENDED, "PHỤ LỤC (Kèm theo")]


def test_texts_without_marks_are_not_searched(spark):
    from quillon.operators.listings import normalise_legal

    texts = ["a\r\n\r\n\r\n\rb\t\xa0 c", "  ", "x \x85", "nghi  didnh nd - cp  tt btc", "Ả̀é đĐ", "**Điều 1. A** b\n # c", "Điều\n 4. x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    edges = f"^{T.JS_SPACE}+|{T.JS_SPACE}+$"
    fold = lambda c: F.lower(F.translate(F.regexp_replace(c, "[̀-ͯ]", ""), T.FOLD_FROM, T.FOLD_TO))
    plain = F.trim(T.replace_all(fold(F.regexp_replace("t", "\xa0", " ")), T.QUERY_RULES))
    found = rows.select(T.normalise_query(F.col("t")), plain, T.tidy(F.col("t")), F.regexp_replace(T.replace_all(F.col("t"), T.SPACE_RULES), edges, ""), T.squeeze(F.col("t")), F.trim(F.regexp_replace("t", r"[\s\xa0]+", " ")))
    assert [(r[0], r[2], r[4]) for r in found.collect()] == [(r[1], r[3], r[5]) for r in found.collect()]
    assert [r[0] for r in rows.select(normalise_legal(F.col("t"))).collect()][5:7] == ["Điều 1. A\nb\nc", "Điều 4. x"]
    for made in (T.normalise_query, T.tidy, T.squeeze, normalise_legal):
        plan = rows.select(made(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("case when") >= 1 and plan.count("contains(") >= 1


def test_pages_are_joined_once(spark, sf_dir):
    from quillon.plans import presentation

    assert "join " not in presentation.provisions_of_pages(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_sentences_are_cut_and_points_are_chosen_once(spark, tmp_path):
    from quillon.operators import storyboard as S
    from quillon.plans.storyboard import CATEGORIES, titled

    texts = ["The one sentence has 12 words and is long enough to stand here. Une phrase avec les mots | et encore. kurz und gut 7.", "Nothing the least; the end 5. the the", "", None]
    docs = titled(spark.createDataFrame([(n, t, "web") for n, t in enumerate(texts)], "doc_id INT, text STRING, source STRING"))
    first = S.repaired(docs, spark.createDataFrame([], "key INT, nth INT, claim STRING, covers ARRAY<STRING>, importance INT"), "doc_id", "text", CATEGORIES)
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[.!?;:]") == 1  # sentences, for all categories
    got = {(r["key"], r["covers"][0]): r["claim"] for r in first.collect()}
    assert got[0, "french"] == "Une phrase avec les mots | et encore." == got[0, "table"] and got[0, "german"] == "kurz und gut 7." and {key for key, _ in got} == {0, 1}
    plain = S.storyboards(docs, "doc_id", "text", "title", CATEGORIES, "standard", False)
    board = S.storyboards(docs, "doc_id", "text", "title", CATEGORIES, "standard", False, f"file://{tmp_path}")
    assert sorted(map(str, board.collect())) == sorted(map(str, plain.collect()))
    assert "array_except" not in board._jdf.queryExecution().optimizedPlan().toString()  # the choice is read, not made again


def test_segments_are_normalised_once(spark):
    from quillon.operators import anchored as A
    from quillon.plans.anchored import ASKED

    texts = [(q, q, 0, 1, "Điều 1", t) for q in range(5) for t in ("| 2 | sửa đổi tờ khai the and", "[7] mẫu số", "heitü phạm vi điều chỉnh 3.", "", None)]
    rows = spark.createDataFrame(texts, "qid INT, cid INT, provision INT, chunk INT, label STRING, text STRING")
    found = A.scored(rows, spark.createDataFrame(ASKED, "qid INT, query STRING"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") >= 3 and "AS plain" not in plan  # the text alone is normalised for questions on forms only
    got = {(r["qid"], r["text"]): (r["hits"], r["score"]) for r in found.collect()}
    assert [got[q, "| 2 | sửa đổi tờ khai the and"][0] for q in range(5)] == [1, 0, 0, 0, 0] and got[2, "heitü phạm vi điều chỉnh 3."] == (0, 0.186667) and got[1, "heitü phạm vi điều chỉnh 3."][1] == 0.9
    assert got[1, "| 2 | sửa đổi tờ khai the and"][1] == 2.4 and got[4, ""] == (0, 0.0)


def test_scored_sources_are_read_not_found_again(spark, sf_dir):
    from quillon.plans import search

    plan = search.answered_queries(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "translate(source_number" not in plan and "https://example.org/" not in plan  # sources are described where they are scored, and read behind it
