"""Source divergence against plain Python integers and DuckDB."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillon.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SHAPE = "doc_id BIGINT, text STRING, lang STRING, source STRING, n INT, term STRING"


def brute_force(rows, top=200):
    docs = [tuple("" if x is None else x for x in r) for r in rows]
    counts, inside = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        inside[lang].update(set(terms))
    out = set()
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in inside[lang].items() if n >= 3]
        sources = [s for k, s in counts if k == lang]
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, n) for n, (value, item) in enumerate(found, 1)}
    return out


def got_of(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_docs(seed, n, sources):
    rng = random.Random(seed)
    words = ["The", "the", "it's", "x1y", "é", "É", "世界", "ｗ", "\U0001f389", "ß", "A-b_c", "[", "~", "word", "wordy", "zz", "İ"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(12) for j in range(9)]
    rows = []
    for k in range(n):
        text = rng.choice([None, "", "12 34 . \n"]) if rng.random() < 0.15 else " ".join(rng.choices(words, k=rng.randint(1, 60)))
        lang, source = rng.choice([None, "", "en", "en", "en", "de", "xx"]), rng.choice([None, "", *sources])
        rows.append((k, text if lang != "xx" else f"only{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}", lang, source, 1, "t"))
    return rows


@pytest.mark.parametrize(("cells", "pairs", "entries"), [(1 << 20, 1 << 20, 200_000), (40, 7, 25)])
def test_audit_equals_brute_force(spark, monkeypatch, cells, pairs, entries):
    for name, value in (("CELLS", cells), ("PAIRS", pairs), ("ENTRIES", entries)):
        monkeypatch.setattr(divergence, name, value)
    rows = odd_docs(5, 150, ["a", "b", "B", "é", "src10", "src9"])
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    assert got_of(divergence.audit(df)) == brute_force([r[1:4] for r in rows])
    assert got_of(divergence.audit(df, top=2)) == brute_force([r[1:4] for r in rows], 2)


def test_groups_without_terms(spark):
    rows = [(1, None, None, None, 1, ""), (2, "..", "", "s", 1, ""), (3, "a a a", "", "t", 1, ""), (4, "b", "zz", "only", 1, "")]
    df = spark.createDataFrame(rows, SHAPE)
    got = got_of(divergence.audit(df))
    assert got == brute_force([r[1:4] for r in rows]) and ("", "", "pair", "s", 0, 1) in got and not any(r[0] == "zz" for r in got)
    assert divergence.audit(df.limit(0)).count() == 0


def test_large_counts_stay_exact():
    rng = random.Random(3)
    for _ in range(200):
        total, kept = rng.randrange(1, 8 * 10**13), rng.randrange(1, 10**9)
        count = rng.randrange(0, total + 1)
        assert divergence.share(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 1) // (total + kept)
    for p, q in ((1_000_000_001, 1), (1, 1_000_000_001), (5, 9)):
        assert divergence.apart(np.array([p]), np.array([q]))[0] == (p - q) ** 2 // q
    cells, counts = np.array([0, 0, 2]), np.array([2**53 + 1, 2**40 + 3, 7])
    assert divergence.binned(cells, counts, 4).tolist() == [2**53 + 2**40 + 4, 0, 7, 0]


def test_query_equals_its_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {tuple(r) for r in duck.execute(queries.ORACLE["op11_source_divergence"]).fetchall()}
    got = queries.op11_source_divergence(spark, sf_dir)
    assert got_of(got) == want and dict(got.dtypes)["rank"] == "int"
