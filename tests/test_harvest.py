"""Strings of JSON against a recursive walk."""

import json
import random

from quillon.operators import harvest as H


def walk(value, depth, path=()):
    if isinstance(value, str):
        return [(path, value)]
    inner = enumerate(value) if isinstance(value, list) else enumerate(v for _, v in sorted(value.items())) if isinstance(value, dict) else ()
    return [x for n, v in inner for x in walk(v, depth - 1, (*path, n))] if depth else []


def generated(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice(["a", "", "see https://x.example/a.pdf.", "http://y.example/b.DOCX?c=1", 5, 1.5, None, True, "é\n"])
    if kind < 0.7:
        return [generated(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {f"k{n}": generated(rng, depth - 1) for n in range(rng.randint(0, 4))}


def test_strings_equal_a_walk(spark):
    rng = random.Random(6)
    values = [generated(rng, 9) for _ in range(300)]
    rows = [(n, json.dumps(v)) for n, v in enumerate(values)] + [(900, None), (901, "{broken"), (902, ""), (903, '"top https://t.example/x.doc,"')]
    got = {}
    for r in H.strings(spark.createDataFrame(rows, "id INT, j STRING"), "id", "j").collect():
        got.setdefault(r["id"], []).append((tuple(r["path"]), r["text"]))
    want = {n: sorted(walk(v, 6)) for n, v in enumerate(values)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} | {903: [((), "top https://t.example/x.doc,")]}


def test_bounds_and_links(spark):
    rows = [(1, json.dumps(["https://a.example/1.pdf", {"x": "https://a.example/2.docx#top and https://a.example/3.doc."}, "https://a.example/1.pdf"])), (2, json.dumps({"a": ["x"] * 9})), (3, json.dumps([[["https://deep.example/"]]]))]
    df = spark.createDataFrame(rows, "id INT, j STRING")
    got = {r["id"]: (r["n_strings"], r["n_links"], r["best"]) for r in H.best_links(df, "id", "j").collect()}
    assert got == {1: (3, 3, "https://a.example/2.docx#top"), 2: (9, 0, None), 3: (1, 1, "https://deep.example/")}
    assert {r["id"]: r["n_strings"] for r in H.best_links(df, "id", "j", depth=2, most=4).collect()} == {1: 3, 2: 4}
    assert H.best_links(df.limit(0), "id", "j").count() == 0
