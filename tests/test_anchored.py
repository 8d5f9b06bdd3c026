"""Anchored evidence: selection against a loop, and what questions ask for."""

import random

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import anchored as A

SHAPE = "qid INT, cid INT, provision INT, chunk INT, label STRING, text STRING, hits INT, score DOUBLE"


def by_loop(rows):
    """Seeds and the chunks beside them first, then by rank until there are twelve; the first twelve of these by rank."""
    ranked = sorted(rows, key=lambda r: (-r[6], -r[7], r[2], r[3]))
    seeds = [r for r in ranked if r[6] > 0][:5]
    chosen = list(seeds)
    for s in seeds:
        chosen += [r for r in rows if r[2] == s[2] and abs(r[3] - s[3]) == 1 and r not in chosen]
    for r in ranked:
        if len(chosen) >= 12:
            break
        if r not in chosen:
            chosen.append(r)
    return [(r[2], r[3], n + 1) for n, r in enumerate([r for r in ranked if r in chosen][:12])]


def test_selection_equals_a_loop(spark):
    rng = random.Random(7)
    rows = []
    for qid in range(2):
        for cid in range(60):
            for p in range(rng.randint(0, 9)):
                rows += [(qid, cid, p, c, "l", f"t{p}{c}", rng.choice([0, 0, 0, 1, 2]), rng.choice([0.0, 0.5, 1.0, 2.0])) for c in range(rng.randint(1, 7))]
    got = {}
    for r in A.evidence(spark.createDataFrame(rows, SHAPE)).orderBy("place").collect():
        got.setdefault((r["qid"], r["cid"]), []).append((r["provision"], r["chunk"], r["place"]))
    want = {}
    for key in {r[:2] for r in rows}:
        want[key] = by_loop([r for r in rows if r[:2] == key])
    assert got == want and max(map(len, want.values())) == 12


def test_questions(spark):
    asked = ["Theo Thông tư 80/2021/TT-BTC, chỉ tiêu [22] trên tờ khai là gì", "Phân tích Nghị định số 181/2025/NĐ-CP", "Nghị định 15/2020", "ô 5 và ô 12 ghi gì năm 2024", ""]
    n = T.normalise_query(F.col("q"))
    got = spark.createDataFrame(list(enumerate(asked)), "i INT, q STRING").select(A.matter(n).alias("m"), A.fields_of(n).alias("f")).collect()
    assert [r["f"] for r in got] == [[22], [], [], [5, 12], []] and got[0]["m"] == "chi tieu 22 tren to khai la gi" and got[1]["m"] == "phan tich" and got[2]["m"] == "nghi dinh 15/2020"


def test_fields_are_found_whole(spark):
    texts = ["[22] tiền thuế", "Chỉ tiêu 22 là", "chỉ tiêu [ 22 ]", "a\n22. dòng", "| 22 | ô", "khoản 122 và 22 đồng", "[222]", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in df.select(A.field_hits(F.coalesce("t", F.lit("")), F.array(F.lit(22), F.lit(7)))).collect()]
    assert got == [1, 1, 1, 1, 1, 0, 0, 0]


def test_answers_take_texts_once(spark):
    rows = [(1, c, 0, k, f"Điều {c}", t, h, s) for c, k, t, h, s in [(1, 0, "một", 1, 5.0), (2, 0, "một", 1, 5.0), (1, 1, "hai", 0, 2.0), (1, 2, "không", 0, 0.0), (3, 0, "ba", 2, 1.0)]]
    chosen = A.evidence(spark.createDataFrame(rows, SHAPE))
    assert A.answers(chosen).first()["excerpts"] == ["Điều 3\nba", "Điều 1\nmột", "Điều 1\nhai"] and A.answers(chosen.limit(0)).count() == 0


def test_segments_arent_shuffled_by_question(spark, sf_dir):
    from quillon.plans import anchored as P

    assert "BroadcastHashJoin" in P.anchored_answers(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
