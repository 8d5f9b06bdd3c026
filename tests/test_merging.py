"""Merges by precedence on planted rows."""

from pyspark.sql import functions as F

from quillon.operators import merging as M


def test_merges_by_relevance_and_first(spark):
    rows = spark.createDataFrame([(1, "u", 2.0, -3.0, False), (2, "u", 1.0, 1.5, False), (3, "u", 9.0, 0.0, True), (4, "v", 1.0, -1.0, False), (5, "v", 1.0, 0.0, False)], "n INT, url STRING, score DOUBLE, relevance DOUBLE, out BOOLEAN")
    got = M.merge_relevant(rows, ["url"], F.col("out"), F.col("relevance"), "n").collect()
    assert {(r["url"], r["n"], r["score"]) for r in got} == {("u", 2, 2.5), ("v", 4, 1.0)}
    rows = spark.createDataFrame([(1, "8/2026/TT-BTC", "Bộ A"), (2, "8 / 2026 / tt-btc", "bo a"), (3, "8/2026/TT-BTC", "Bộ B"), (4, None, None), (5, " ", "")], "n INT, number STRING, issuer STRING")
    assert sorted(r["n"] for r in M.first_candidates(rows, "n", F.col("number"), F.col("issuer")).collect()) == [1, 3, 4]
    assert [r["n"] for r in M.first_candidates(rows, "n", F.col("number")).collect()] == [1]


def test_precedence_and_retries(spark):
    columns = "n INT, document_number STRING, url STRING, issued_date STRING, score DOUBLE"
    row = lambda n, number, score: (n, number, "https://a", "2026-05-01", score)
    exact = spark.createDataFrame([row(1, "A/1", 0.0), row(2, "a / 1", 9.0)], columns)
    latest = spark.createDataFrame([row(3, "A/1", 0.0), row(4, "B/1", 9.0), row(5, "B/1", 0.0)], columns)
    topical = spark.createDataFrame([row(6, "B/1", 99.0), row(7, "Đ/1", 1.0), row(8, "d/1", 2.0), row(9, "D/1", 2.0)], columns)
    assert sorted(r["n"] for r in M.precedence_union(exact, latest, topical, "n").collect()) == [1, 5, 8]
    odd = spark.createDataFrame([(1, "1/2026/X", "u", None, 0.0), (2, "1/2025/X", "u", None, 0.0), (3, "1/2025/X", "u", "2026-04-02", 0.0), (4, None, "u", "2026-04-02", 0.0), (5, "1/2026/X", None, None, 0.0)], columns)
    assert sorted(r["n"] for r in odd.where(M.recent_topical(odd, "2026-04-01", 2026)).collect()) == [1, 3]
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "page INT, text STRING")
    again = spark.createDataFrame([(2, "B"), (4, "D")], "page INT, text STRING")
    assert sorted(r["page"] for r in M.missing_pages(pages, again, ["page"]).collect()) == [1, 3]
    assert sorted((r["page"], r["text"]) for r in M.merge_pages(pages, again, ["page"], "text").collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "D")]


def test_query_blocks_equal_the_broadcast(spark):
    from quillon.operators.pairs import with_queries

    rows = spark.range(50).selectExpr("IF(id = 0, NULL, id) AS cid", "id % 3 AS x")
    asked = spark.range(23).selectExpr("IF(id = 1, NULL, id) AS qid", "id AS y")
    pairs = lambda df: sorted((r["x"], r["y"], repr(r["cid"]), repr(r["qid"])) for r in df.collect())
    dealt = with_queries(rows, asked, 23, block=5, slices=3)
    assert dealt.columns == ["cid", "x", "qid", "y"] and pairs(dealt) == pairs(with_queries(rows, asked, 23)) and dealt.count() == 50 * 23
    assert with_queries(rows, asked.limit(0), 0).count() == 0
