"""The index against all pairs, and the whole search on small collections."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import index as I
from quillon.operators import retrieval as R
from quillon.operators import search as S
from quillon.sources.shared import shared_folder


def all_pairs(spark, docs, queries, k):
    scored = R.lexical_relevance(queries, docs)
    return {(r["qid"], r["rank"]): (r["cid"], r["relevance"]) for r in R.top_candidates(scored, k).collect()}


def by_index(spark, docs, queries, k, heavy=I.HEAVY):
    index = I.build(docs, shared_folder(spark, "test-index"), heavy=heavy)
    return {(r["qid"], r["rank"]): (r["cid"], r["relevance"]) for r in I.search(index, queries, k).collect()}


@pytest.mark.parametrize(("heavy", "k"), [(I.HEAVY, 5), (3, 5), (1, 2), (10, 1000)])
def test_index_equals_all_pairs(spark, heavy, k):
    rng = random.Random(heavy * k)
    words = "hoa don khai thue ho so kinh doanh chinh sach doanh thu mien streamer tiktoker apple app applesauce le pie ap".split()
    texts = [None, "", "  ", *[" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(150)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "cid INT, body STRING")
    asked = ["", "the", "app le pie", "apple pie", "ho kinh doanh doanh thu bao nhieu", "ho so khai thue", "hoa don", "youtuber", "le pie ap", "ap", "zzz"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid INT, query STRING")
    assert by_index(spark, docs, queries, k, heavy) == all_pairs(spark, docs, queries, k)


def test_index_builds_no_pair_without_a_token(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("cid"), F.col("text").alias("body"))
    queries = spark.createDataFrame([(1, "worthless licence"), (2, "zzzz")], "qid INT, query STRING")
    folder = shared_folder(spark, "test-index")
    index = I.build(docs, folder)
    found = I.search(I.open_index(spark, folder), queries, 10)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    pairs = I.matches(index, I.asked_of(queries)).collect()
    assert {(p["qid"], p["cid"]) for p in pairs} == {(r["qid"], r["cid"]) for r in R.lexical_relevance(queries, docs).collect()}
    assert I.search(I.build(docs.limit(0), shared_folder(spark, "test-index")), queries, 3).count() == 0


def source(cid, number, kind="Thông tư", issuer="Bộ Tài chính", issued="2026-06-30", body="", title=None):
    return (cid, number, title or f"{kind} {number}", kind, issuer, issued, f"https://vanban.example.gov.vn/{cid}", body)


SHAPE = "cid BIGINT, number STRING, title STRING, type STRING, issuer STRING, issued STRING, url STRING, body STRING"
LONG = "Quy định chi tiết về hồ sơ khai thuế, hoàn thuế giá trị gia tăng và thời hạn nộp của người nộp thuế tại địa phương. " * 8


def answers(spark, rows, asked, conflicts=()):
    held = spark.createDataFrame(rows, SHAPE)
    queries = spark.createDataFrame(list(enumerate(asked)), "qid INT, query STRING")
    index = I.build(held.select("cid", F.concat_ws(" ", "title", "body").alias("body")), shared_folder(spark, "test-index"))
    said = spark.createDataFrame([(n,) for n in conflicts], "qid INT")
    return {r["qid"]: r for r in S.search(queries, held, index, 2026, said).collect()}


def test_shorthand_with_several_answers_is_ambiguous(spark):
    rows = [source(1, "89/2026/TT-BTC", body=LONG), source(2, "89/2024/TT-BTC", body=LONG), source(3, "89 / 2024 / TT-BTC", body=LONG), source(4, "90/2026/TT-BTC", body=LONG)]
    got = answers(spark, rows, ["Thông tư 89", "Thông tư 89/2026", "Thông tư số 91/2026", "thông tư 90"], conflicts=[0, 2])
    # the copy of 89/2024 by the same issuer is one choice; a contradiction caps what no text settles
    assert got[0]["response"] == "ambiguous" and sorted(got[0]["choices"].split(",")) == ["1", "2"] and got[0]["confidence"] == 0.38 and got[0]["document"] is None
    assert got[1]["response"] == "numbered" and got[1]["document"] == 1 and got[1]["confidence"] == 0.9 and got[1]["kind"] == "document"
    assert got[2]["response"] == "none" and got[2]["confidence"] == 0.35 and got[2]["n_opened"] == 0
    assert got[3]["document"] == 4 and got[3]["choices"] == ""


def test_questions_prefer_new_and_amending_documents(spark):
    lines = "\n".join([f"{LONG[:200]} Điểm {n}." for n in range(6)])
    rows = [
        source(1, "10/2019/TT-BTC", issued="2019-01-01", body=lines + LONG), source(2, "11/2026/TT-BTC", body=lines + LONG), source(3, "12/2026/TT-BTC", body=lines + LONG, title="Thông tư sửa đổi bổ sung 12/2026/TT-BTC"),
        source(4, "13/2026/TT-BTC", body="Khai thuế, hoàn thuế giá trị gia tăng."), source(5, "14/2026/TT-BTC", issuer="Cục Thuế", body=lines + LONG), source(6, "15/2020/TT-BTC", issued="2020-01-01", body=lines + LONG),
    ]
    got = answers(spark, rows, ["hồ sơ khai thuế và hoàn thuế giá trị gia tăng thế nào", ""])[0]
    # too short texts don't open; four do, the amending one first
    assert got["kind"] == "question" and got["response"] == "excerpts" and got["n_opened"] == 4 and got["n_found"] == 6 and got["confidence"] == 0.72
    assert got["document"] == 3 and got["choices"].split(",")[:2] == ["2", "5"]


def test_evidence_takes_each_provision_once(spark):
    lines = "\n".join(f"Đoạn về hồ sơ khai thuế số {n}, " + "nội dung " * 12 for n in range(14))
    rows = [source(1, "10/2026/TT-BTC", body=lines + "\n" + LONG), source(2, "10/2026/TT-BTC", issuer="khác", body=lines + "\n" + LONG)]
    held = spark.createDataFrame(rows, SHAPE)
    hints = R.search_hints(spark.createDataFrame([(1, "hồ sơ khai thuế thế nào")], "qid INT, query STRING")).select("qid", "normalised", "type", "number", "year", "asks_question")
    found = hints.crossJoin(held.select("cid", F.col("number").alias("source_number"), F.col("type").alias("source_type"), "title", "issuer", "issued", "url", "body", F.lit(1.0).alias("relevance")))
    best, excerpts = S.evidence(S.opened(S.source_scores(found, 2026), 2026), 2026)
    assert best.groupBy("cid").count().where("count <> 10").count() == 0 and best.where("place = 1 AND own <= 0").count() == 0
    got = [r["excerpt"].split("\n")[0] for r in sorted(excerpts.collect(), key=lambda r: r["place"])]
    assert len(got) == len(set(got)) == 3


def test_numbers_match_whole(spark):
    texts = ["89/2026/tt-btc", "189/2026", "890/2026", "so 89", "89a", "x89/1"]
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select(S.number_match(F.col("t"), F.lit("89")).alias("m")).collect()
    assert [r["m"] for r in got] == [True, False, False, True, True, True]
    assert all(a is not b for a, b in itertools.pairwise(texts))


def test_a_phrase_that_ties_wins_by_its_key(spark):
    words = "ho kinh doanh aa bb cc dd ee"
    docs = spark.createDataFrame([(1, f"x{words}x"), (2, " ".join(reversed(words.split()))), (3, "aa")], "cid INT, body STRING")
    queries = spark.createDataFrame([(1, words)], "qid INT, query STRING")
    assert by_index(spark, docs, queries, 1) == all_pairs(spark, docs, queries, 1) and by_index(spark, docs, queries, 1)[1, 1][0] == 1


def test_excerpts_end_behind_a_sentence_of_the_stated_least(spark):
    from quillon.functions import text as T

    texts = ["a" * n + ". " + "b" * 900 for n in (420, 421, 430, 450)]
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select(T.compact_excerpt(F.col("t"), 900, 421), T.compact_excerpt(F.col("t"), 900)).collect()
    assert [len(r[0]) for r in got] == [901, 422, 431, 451] and [len(r[1]) for r in got] == [901, 901, 901, 451]
