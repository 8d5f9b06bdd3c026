"""Conversation repair against an exhaustive search, a shortest-path search and its own form in blocks."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import conversations, queries

SPACE = " \t\n\x0b\f\r"
SHAPE = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, alive INT, best STRING"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.strip(SPACE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def next_state(state, letter):
    return {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, letter))


def shortest(rows, kinds):
    """Dijkstra over (turns taken, state), by cost and then by audit; lines come along."""
    queue, done = [(0, "", 0, "e", ())], set()
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in "ea":
            return cost, audit, "\n".join(lines)
        for name in ("user", "assistant"):
            if after := next_state(state, name[0]):
                heapq.heappush(queue, (cost + 3, audit + "I", at, after, (*lines, f"{name}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, lines))
            if kinds[at] not in ("blank", "duplicate"):
                late = 3 * (kinds[at] == "truncated")
                if after := next_state(state, role[:1]):
                    heapq.heappush(queue, (cost + late, audit + "K", at + 1, after, (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if after := next_state(state, name[0]):
                        heapq.heappush(queue, (cost + late + 3, audit + "R", at + 1, after, (*lines, f"{name}:{text}")))
    raise AssertionError


def exhaustive(rows, kinds):
    """All edits with up to two inserts at each place."""
    best = None
    gaps = [g for n in range(3) for g in itertools.product("ua", repeat=n)]
    for places in itertools.product(gaps, repeat=len(rows) + 1):
        for ops in itertools.product(("D", "K", "Ru", "Ra"), repeat=len(rows)):
            cost, audit, roles = 0, "", ""
            for n, gap in enumerate(places):
                cost, audit, roles = cost + 3 * len(gap), audit + "I" * len(gap), roles + "".join(gap)
                if n < len(rows):
                    op, kind = ops[n], kinds[n]
                    audit += op[0]
                    cost += 4 if op == "D" else (0 if op == "K" else 3) + 3 * (kind == "truncated") + 1000 * (kind in ("blank", "duplicate"))
                    roles += "" if op == "D" else (rows[n][1][:1] or "?") if op == "K" else op[1]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def wanted(rows):
    """The result for one conversation's rows."""
    after = damaged(rows)
    kinds = faults(after)
    cost, audit, text = shortest(after, kinds)
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r[:4])
    return {k: wanted(v) for k, v in convs.items()}


def odd_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "unknown"]
    texts = ["yes.", "no!", "why? ", "half", "", None, " \t\n\x0b\f\r", "é ñ 世界。", "end.\n", "a.b", " ", "long " * 300 + "."]
    rows = []
    for conv in [None, *range(convs)]:
        for n in range(rng.randint(1, most)):
            rows += [(conv, rng.choice([n, n, n, n + 5, None, 2]), rng.choice(roles), rng.choice(texts), 1, "x")] * rng.choice([1, 1, 1, 1, 2])
    return rows


def got_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_search_equals_exhaustive_search():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(n, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", "c!"])) for n in range(rng.randint(0, 2))]
        kinds = faults(rows)
        assert shortest(rows, kinds)[:2] == exhaustive(rows, kinds)


def test_repair_equals_shortest_paths(spark):
    rows = odd_rows(1, 300, 9)
    df = spark.createDataFrame(rows, SHAPE)
    assert got_of(conversations.repair(df).drop("conv_id")) == expected(rows)


def test_blocks_equal_collected_conversations(spark, monkeypatch):
    rows = odd_rows(2, 30, 60)
    df = spark.createDataFrame(rows, SHAPE)
    for long, block in ((0, 4), (20, 1), (40, 7)):
        monkeypatch.setattr(conversations, "LONG", long)
        monkeypatch.setattr(conversations, "BLOCK", block)
        assert got_of(conversations.repair(df)) == expected(rows)


def test_long_conversation_of_one_turn_number(spark, monkeypatch):
    """Null turns alone, which damage drops together or not at all."""
    monkeypatch.setattr(conversations, "LONG", 50)
    monkeypatch.setattr(conversations, "BLOCK", 16)
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}: ".encode()) % 20 == 0)
    kept = next(n for n in range(1000) if zlib.crc32(f"{n}: ".encode()) % 20 > 4)
    rows = [(c, None, ["user", "assistant"][n % 2], f"text {n % 90}.", 1, "x") for c in (gone, kept, None) for n in range(200)]
    assert got_of(conversations.repair(spark.createDataFrame(rows, SHAPE))) == expected(rows)
    assert expected(rows)[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edges(spark):
    df = spark.createDataFrame(odd_rows(3, 2, 3), SHAPE)
    assert conversations.repair(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], "conv_id INT, turn BIGINT, role STRING, text STRING")
    assert conversations.repair(wide).first()["gaps"] in (None, 0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_whole_tables(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, f"/root/testdata/{sf}")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got_of(got) == expected([tuple(r) for r in table.collect()])
    assert got.where(F.col("audit").contains("K")).count() > 0


def test_sql_equals_shortest_paths(spark, tmp_path):
    import duckdb

    rows = [r for r in odd_rows(9, 120, 8) if r[2] != ""]
    spark.createDataFrame(rows, SHAPE).drop("alive", "best").write.parquet(f"{tmp_path}/c")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    got = {r[0]: r[1:] for r in duck.execute(conversations.REPAIR_SQL).fetchall()}
    assert got == expected(rows)
