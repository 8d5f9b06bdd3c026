"""Corpus operators against brute force on small inputs, and their edge cases: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import gzip
import hashlib
import io
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import bpe, hamming, html, licences, mixing, neardup, quality, queries, sharding, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, key STRING, copies INT, h1 INT"


def docs_of(spark, texts, sources=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(n, t, "en", (sources or ["s"])[n % len(sources or ["s"])], None, "k", 1, 2) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "one", "two words", "x" * 50_000, "wide é ñ 世界 🎉 text", "a b c d e f g h i j " * 300]


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 1
def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 64))
    vectors[50:90] = vectors[0]  # copies
    vectors[90] = 0
    rows = [(n, [float(x) for x in v], 0, "q", 1) for n, v in enumerate(vectors)] + [(None, [1.0] * 64, 0, "q", 1), (500, None, 0, "q", 1), (3, [float(x) for x in vectors[3]], 0, "q", 1)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, query STRING, code INT")
    got = {(r["query"], r["rank"]): (r["id"], r["distance"]) for r in hamming.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()}
    bits = vectors > 0
    for q in range(0, 400, 20):
        want = sorted((int((bits[q] != bits[x]).sum()), x) for x in range(400) if x != q)[:7]
        assert [got[q, n + 1] for n in range(7)] == [(x, d) for d, x in want]
    assert hamming.top_k(df.limit(0), F.lit(True), 7).count() == 0
    assert hamming.top_k(df.where("vec_id < 3"), F.lit(True), 7).count() == 6


@pytest.mark.parametrize(("n", "bits", "k"), [(3000, 32, 5), (1500, 100, 3), (900, 64, 1)])
def test_top_k_is_exact_for_other_widths(spark, monkeypatch, n, bits, k):
    rng = np.random.default_rng(bits)
    vectors = rng.normal(size=(n, bits))
    vectors[: n // 3, : bits // 2] = vectors[0, : bits // 2]  # a third shares its first segments
    for name, value in (("SHARD", 700), ("LEAST_SHARD", 300), ("BLOCK", 8), ("SAMPLE", 600), ("TOGETHER", 3)):
        monkeypatch.setattr(hamming, name, value)
    df = spark.createDataFrame([(x, v.tolist()) for x, v in enumerate(vectors)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = {(r["query"], r["rank"]): (r["id"], r["distance"]) for r in hamming.top_k(df, F.col("vec_id") % 100 == 0, k, bits).collect()}
    codes = vectors > 0
    for q in range(0, n, 100):
        want = sorted((int((codes[q] != codes[x]).sum()), x) for x in range(n) if x != q)[:k]
        assert [got[q, r + 1] for r in range(k)] == [(x, d) for d, x in want]


def test_pairs_are_met_once_and_radii_stop_when_the_kth_is_covered():
    widths = hamming.segment_widths(44)
    assert widths == [15, 15, 14]
    rng = np.random.default_rng(5)
    codes = np.stack([rng.integers(0, 1 << w, 2000) for w in widths], axis=1)
    shard = hamming.Shard(codes, widths)
    far = np.bitwise_count((codes[:9, None] ^ codes[None]).astype(np.uint64)).sum(axis=2)
    met = Counter(p for radius in range(16) for s, w in enumerate(widths) if radius <= w for p in zip(*(x.tolist() for x in shard.look_up(codes[:9].astype(np.uint64), s, radius)[:2])))
    assert len(met) == 9 * 2000 and set(met.values()) == {1}
    looked = []
    monkey = shard.look_up
    shard.look_up = lambda asked, s, radius: looked.append(radius) or monkey(asked, s, radius)
    who, code, distance = shard.search(codes[:9], 5, np.full(9, 44))
    for q in range(9):
        limit = np.sort(far[q])[4]
        assert sorted(zip(distance[who == q].tolist(), code[who == q].tolist())) == sorted((int(far[q, x]), int(x)) for x in np.flatnonzero(far[q] <= limit))
    assert max(looked) <= max(np.sort(far, axis=1)[:, 4]) // 3 + 1


def test_top_k_of_repeated_ids_and_texts(spark):
    rows = [("1", [1.0, 1.0]), ("1", [-1.0, -1.0]), ("2", [1.0, -1.0]), ("x", [1.0, 1.0]), ("3", [-1.0, -1.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id STRING, embedding ARRAY<DOUBLE>")
    got = [(r["query"], r["rank"], r["id"], r["distance"]) for r in hamming.top_k(df, F.col("vec_id") == "1", 5, 2).collect()]
    assert sorted(got) == [(1, 1, 3, 0), (1, 2, 2, 1)]


# 2
def test_shards_fit_and_hold_all_rows(spark, small):
    limit = 30_000
    rows = [r.asDict() for r in sharding.assign_shards(small, limit).collect()]
    assert len(rows) == small.count()
    for shard in {r["shard"] for r in rows}:
        inside = [r for r in rows if r["shard"] == shard]
        assert sum(r["n_bytes"] for r in inside) == inside[0]["shard_bytes"] and len(inside) == inside[0]["shard_rows"]
        assert inside[0]["shard_bytes"] <= limit or len(inside) == 1 and inside[0]["oversized"]
    names = sorted({r["shard"] for r in rows})
    assert not any(b.startswith(a) for a, b in itertools.pairwise(names))


def test_repeated_rows_overflow(spark):
    df = docs_of(spark, ["same"] * 1).crossJoin(spark.range(40).select(F.lit(1).alias("of"))).unionByName(docs_of(spark, ODD), allowMissingColumns=True)
    rows = sharding.assign_shards(df, 20).collect()
    assert len(rows) == 40 + len(ODD)
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["n_bytes"]
        assert r["oversized"] == (r["n_bytes"] > 20)
    assert all(n <= 20 for s, n in sizes.items() if "+" in s)
    assert sharding.assign_shards(df.limit(0), 20).count() == 0


def test_shards_are_written_once_for_each_row(spark, tmp_path):
    df = docs_of(spark, [*ODD, "same"]).unionByName(docs_of(spark, [*ODD, "same"]))
    df = df.unionByName(df.withColumn("doc_id", F.lit(None).cast("bigint")))
    listed = sharding.write_shards(df, 2000, f"{tmp_path}/s")
    back = spark.read.option("basePath", f"{tmp_path}/s").parquet(f"{tmp_path}/s")
    assert back.count() == df.count() == listed.agg(F.sum("shard_rows")).first()[0]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    assert {r["shard_bytes"] <= 2000 or r["shard_rows"] == 1 for r in listed.collect()} == {True}
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(df.withColumn("shard", F.lit(1)), 2000, f"{tmp_path}/t")


# 3
def test_mix_meets_targets(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(1, 200, 1200)]
    df = docs_of(spark, texts, ["a", "b", "c", None]).unionByName(docs_of(spark, [None, ""]).withColumn("doc_id", F.col("doc_id") + 5000))
    rows = mixing.plan(df).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= 0.03 * sizes[s] + 200
    again = {(r["key"], r["copies"]) for r in mixing.plan(df).collect()}
    assert again == {(r["key"], r["copies"]) for r in rows}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in rows)


def water_fill(sizes, weights, total):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while open_ and left > 1e-9:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        left = 0
        for s, x in share.items():
            room = 2 * sizes[s] - target[s]
            target[s] += min(x, room)
            left += max(0, x - room)
        open_ = {s for s in open_ if target[s] < 2 * sizes[s] - 1e-9}
    return target


def test_targets_equal_iterated_resharing(spark):
    sizes = {"a": 10, "b": 400, "c": 30, "d": 500, "e": 5, None: 60}
    df = spark.createDataFrame(list(sizes.items()), "source STRING, size BIGINT")
    weights = dict(zip(["a", "b", "c", "d", "e", None], itertools.cycle([3, 1, 2])))
    got = {r["source"]: r["target"] for r in mixing.shares(df, (3, 1, 2), (3, 2), 2).collect()}
    assert got == pytest.approx(water_fill(sizes, weights, 1.5 * sum(sizes.values())))


def test_mix_of_nothing_and_of_repeated_keys(spark):
    df = docs_of(spark, ["a b c"])
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    same = df.unionByName(df).unionByName(df.withColumn("text", F.lit("other text here now")))
    assert mixing.mix(same).count() == mixing.plan(same).agg(F.sum("copies")).first()[0]


def test_mix_of_one_row_repeated_very_often(spark):
    df = docs_of(spark, ["a b c d"]).crossJoin(spark.range(900).select(F.lit(1).alias("of"))).unionByName(docs_of(spark, [f"w{n} x y" for n in range(300)]).withColumn("of", F.lit(2)).withColumn("doc_id", F.when(F.col("doc_id") > 9, F.col("doc_id"))))
    rows = mixing.plan(df).collect()
    assert len(rows) == 1200 and all(0 <= r["copies"] <= 2 for r in rows)
    assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 8
    mixed = mixing.mix(df)
    assert mixed.count() == sum(r["copies"] for r in rows) and mixed.columns == df.columns


# 4
PAGE = """<html><head><title>t</title><style>x</style></head><body><div class="site-header"><a href=/>Home</a></div><ul id="nav"><li><a>Menu</a></ul>
<div id="cookie-notice">We use cookies, a lot, really.</div><div class="content"><h1>A &amp; B</h1><p>First paragraph, with commas, and enough length to score&nbsp;well.</p>
<p>Second   one<br>goes on<div class="ad">Buy, buy, buy!</div><ul><li>item<li>next</ul></div><div class="comments"><p>I disagree, as a reader, with all of it, and at length.</p></div>
<aside>side</aside><form><p>sign up</p></form><footer>foot</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "A & B\nFirst paragraph, with commas, and enough length to score well.\nSecond one goes on\nitem\nnext"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("<p>cut &amp; o<b>ff") == "cut & off"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"
    assert html.main_text("<article><p>a<p>b</article><nav>n</nav>") == "a\nb"


def test_main_text_keeps_what_stands_between_kept_blocks():
    long = "A paragraph, with some commas, that goes on for long enough to be scored as the text of a page."
    page = f"<body><div class=menu><a href=/>Home</a></div><div>{f'<p>{long}' * 6}</div><pre>code = 1</pre><ul><li>first<li>second</ul><div>{f'<p>{long}' * 3}</div><ul><li><a href=/>next</a></ul></body>"
    assert html.main_text(page) == "\n".join([*[long] * 6, "code = 1", "first", "second", *[long] * 3])
    assert html.main_text(f"<article><p>{long}<p>As <math><mi>x</mi> = <mn>1</mn></math> shows.</article>") == f"{long}\nAs x = 1 shows."


def test_extract_odd_pages(spark):
    long = "<p>" + " ".join(["Words, and words."] * 30_000) + "</p>"
    rows = [(1, None, "old"), (2, "", "old"), (3, PAGE, "old"), (3, PAGE, "old"), (None, long, None), (4, "<nav>only a menu</nav>", "")]
    df = spark.createDataFrame(rows, "page_id BIGINT, html STRING, text STRING")
    got = html.extract(df)
    assert got.columns == df.columns
    texts = {(r["page_id"], r["text"]) for r in got.collect()}
    assert texts == {(1, ""), (2, ""), (3, html.main_text(PAGE)), (None, " ".join(["Words, and words."] * 30_000)), (4, "")} and html.extract(df.limit(0)).count() == 0


def test_pages_equal_their_article(spark, sf_dir):
    rows = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    for r in rows:
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        parts = (" ".join(html.references.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", inner))
        assert r["text"] == "\n".join(x for x in parts if x)


# 5
def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 200 + "</p>"
    rows = [(3, "http://a/b c\r\nd", long, 1), (1, None, long, 1), (7, "u", long, 1), (4, "u", "short", 1), (5, "u", "short", 1), (6, "u", None, 1), (None, "u", long, 1), (1, "u", long, 1)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, digest INT")
    back = warc.round_trip(pages).collect()
    assert len(back) == len(rows) and all(r["problem"] is None for r in back)
    found = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back)
    n = len(long.encode())
    assert found == Counter([(3, "revisit", 1, n), (1, "response", None, n), (1, "response", None, n), (7, "revisit", 1, n), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (None, "revisit", 1, n)])
    assert all(r["payload_digest"] == hashlib.sha256((long if r["payload_bytes"] == n else "short" if r["payload_bytes"] else "").encode()).hexdigest() for r in back)
    manifest = warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}/w")
    assert {bytes(r["payload"]) for r in warc.read_archives(manifest).collect() if r["payload"]} == {long.encode(), b"short"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_reader_reports_damage():
    good = warc.record(1, "u", b"abc" * 50, 150, hashlib.sha256(b"abc" * 50).hexdigest(), None)
    text = gzip.decompress(good)
    wrong = [text.replace(b"abcabc", b"abcabd", 1), text.replace(b"\r\nContent-Length: 1", b"\r\nContent-Length: 9", 1), text[:-4]]
    data = good + b"".join(gzip.compress(x) for x in wrong) + good
    got = [r["problem"] for r in warc.Reader(io.BytesIO(data))]
    assert got[0] is None and got[1] == "block digest" and all(got[2:4]) and got[4] is None
    assert [r["problem"] for r in warc.Reader(io.BytesIO(good[:-5]))][0]
    one = zlib.decompressobj(31)
    one.decompress(good + good)
    assert one.unused_data == good  # one member to a record


# 6
def brute_components(texts, shingle, percent):
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(n) for n in range(len(texts))]


def near_copies(rng, n, length, edits):
    base = [f"w{x}" for x in rng.integers(0, 5000, length)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.integers(0, length, edits):
            words[at] = f"z{rng.integers(0, 10_000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, shingle, percent):
    rng = np.random.default_rng(shingle)
    texts = [*ODD, "ONE", "One ", *near_copies(rng, 60, 150, 4), *near_copies(rng, 30, 80, 2), *near_copies(rng, 20, 200, 12)]
    df = docs_of(spark, texts)
    got = {r["key"]: r for r in neardup.components(df, neardup.Settings(shingle, percent)).collect()}
    sizes, roots = brute_components(texts, shingle, percent)
    assert [got[n]["n_shingles"] for n in range(len(texts))] == sizes
    assert [got[n]["component_id"] for n in range(len(texts))] == roots
    assert all(got[n]["kept"] == (roots[n] == n) for n in range(len(texts)))
    kept = neardup.keep_one(df, neardup.Settings(shingle, percent))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))


def test_components_of_nothing_nulls_and_repeats(spark):
    df = docs_of(spark, ["a b c d e f", "g h i j k l"])
    assert neardup.components(df.limit(0)).count() == 0
    odd = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = neardup.components(odd).collect()
    assert Counter(r["component_id"] for r in rows) == {0: 3, 1: 3}
    assert sorted(r["doc_id"] for r in neardup.keep_one(odd).collect()) == [0, 1]


def test_keep_one_loses_no_text_under_null_and_repeated_ids(spark):
    one, two, three, four, five = (" ".join(f"{c}{n}" for n in range(40)) for c in "abcde")
    rows = [(None, one), (None, two), (None, two), (None, ""), (7, three), (7, four), (3, five), (7, f"{five} more"), (7, three), (None, f"{four} more")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = [(r["doc_id"], r["text"]) for r in neardup.keep_one(df).collect()]
    assert Counter(got) == Counter([(None, one), (None, two), (None, ""), (7, three), (7, four), (3, five)])


def test_the_last_two_open_nodes_of_a_larger_bucket_are_compared(spark):
    """A bucket of three, of which two nodes are still open, yields their link; so does each block when sets are too large for one."""
    settings = neardup.Settings(5, 80)
    words = [f"w{n}" for n in range(300)]
    near = [*words[:290], *(f"z{n}" for n in range(10))]
    own = neardup.Sketcher(settings)
    sets = [own.shingles(" ".join(x)) for x in (words, near, words[::-1])]
    classes = spark.createDataFrame([(n, bytearray(own.signature(s)), len(s)) for n, s in enumerate(sets)], "node BIGINT, signature BINARY, size BIGINT")
    shingles = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in enumerate(sets)], "node BIGINT, shingles BINARY")
    left, right = (np.frombuffer(own.signature(s), "<u2").reshape(settings.bands, settings.rows) for s in sets[:2])
    band = int((left == right).all(axis=1).argmax())
    members = spark.createDataFrame([(band, 77, n, len(s)) for n, s in enumerate(sets)], "band INT, bucket BIGINT, node BIGINT, size BIGINT")
    none = spark.createDataFrame([], "node BIGINT, root BIGINT")
    opened = neardup.nodes_to_verify(members, none, classes, settings)
    assert sorted(r[0] for r in opened.collect()) == [0, 1]
    links = neardup.block_links(members.join(opened, "node"), none, classes, shingles, settings)
    assert [(r["a"], r["b"]) for r in links.collect()] == [(0, 1)]
    blocks = neardup.deal(members.withColumn("size", F.lit(8 << 20).cast("bigint")), none, 2, True).select("l", "r").distinct().count()
    assert blocks > 4


def test_connected_follows_long_paths(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101), (5, 5)], "a BIGINT, b BIGINT")
    roots = {r["node"]: r["root"] for r in neardup.connected(edges).collect()}
    assert len({roots[n] for n in range(61)}) == 1 and roots[100] == roots[101] != roots[0]


# 7
LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licences(texts):
    """Every template at every alignment of every text, word by word."""
    found = [LICENCE_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    seen = Counter(w for ws in found for w in set(ws))
    idf = lambda w: math.log(1 + (len(texts) + 1) / (seen[w] + 1))
    for ws in found:
        base = [(k, label) for k in range(len(ws)) for p, label in licences.BASE.items() if ws[k : k + len(p.split())] == p.split()]
        labels, best = {x for _, x in base}, 0.5 if base else 0.0
        for label, text, keys in licences.TEMPLATES:
            own = text.split()
            weight, least = sum(map(idf, own)), licences.SHARE_LONG if len(own) > licences.LONG else licences.SHARE_SHORT
            spans = [range(k, k + len(p.split())) for p in keys for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
            for at in range(-len(own), len(ws)):
                same = [0 <= at + k < len(ws) and ws[at + k] == w for k, w in enumerate(own)]
                share = sum(idf(w) for w, x in zip(own, same, strict=True) if x) / weight
                if share >= least - 1e-9 and any(all(same[k] for k in span) for span in spans):
                    labels, best = labels | {label}, max(best, share)
        yield len(ws), base, sorted(labels), best


QUOTED = ["Released under the MIT License.", "GNU General Public License, version 3", "cc by-nc 4.0 CC BY 4.0", "the MIT. licence of Apache", "Permission is hereby granted, free of charge, to any person obtaining a copy",
          "bsd license is not what we use", "Released under the BSD License", "// This program is free software: you can redistribute it and/or modify it", "Permission to use, copy, modify, and/or distribute this software for any purpose",
          "Redistributions of source code must retain the above copyright notice, this list of conditions", "license public general gnu", "modify it and or redistribute can you software free is program this under the license", "subject to the terms of the Mozilla Public License",
          "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. " * 40, "Licensed under CC BY-SA 4.0 and under CC BY-NC 4.0", "words " * 6000 + "released under the apache license version 2.0 " + "words " * 6000]


def test_licences_equal_brute_force(spark, small):
    texts = [*ODD, *QUOTED, *[r["text"] for r in small.collect()]]
    df = docs_of(spark, texts)
    got = {r["key"]: r for r in licences.scan(df).collect()}
    for n, (words, base, labels, score) in enumerate(brute_licences(texts)):
        assert (got[n]["n_words"], got[n]["n_base"]) == (words, len(base))
        assert (got[n]["first_word"], got[n]["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert got[n]["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert got[n]["labels"] == ",".join(labels) and got[n]["score"] == pytest.approx(score), texts[n][:80]
    label = lambda n: got[len(ODD) + n]["labels"]
    assert [label(n) for n in (3, 5, 6, 7, 8, 9, 10, 11, 12)] == ["", "", "bsd", "gpl", "isc", "bsd", "", "", "mpl"]
    assert licences.scan(df.limit(0)).count() == 0


def test_licence_rows_with_null_and_repeated_ids(spark):
    df = docs_of(spark, ["Released under the BSD license"] * 3 + [None]).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id") * 0))
    rows = licences.scan(df).collect()
    assert sorted((r["key"] is None, r["labels"]) for r in rows) == [(False, ""), (False, "bsd"), (True, "bsd"), (True, "bsd")]


# 8
def test_tokens_equal_tiktoken(spark, small):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    true = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [*ODD, "\x1c\x85  a'll 12½ Ⅷ²", "<|endoftext|>", *[r["text"] for r in small.limit(60).collect()]]
    rows = bpe.encode_documents(docs_of(spark, texts), path, public_tokenizers.PATTERN).collect()
    for r in rows:
        assert list(r["ids"]) == true.encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    assert bpe.encode_documents(docs_of(spark, texts).limit(0), path, public_tokenizers.PATTERN).count() == 0


# 9
def brute_counts(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark, small):
    texts = [*ODD, "a\nb\na\n \n \nA", "p q r s t u v w p q r s t u v w x", *[r["text"] for r in small.collect()]]
    got = {r["key"]: r for r in quality.score(docs_of(spark, texts)).collect()}
    for n, t in enumerate(texts):
        r = got[n]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.score(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), F.col("key") == F.col("doc_id")).where("NOT base_failed").select("kept", "quality").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def numpy_em(patterns, counts):
    """EM over two classes of documents and rules that vote or abstain, with the module's start and prior, as arrays."""
    up, down, n = patterns == 1, patterns == -1, np.array(counts, float)
    share, right, wrong = quality.SHARE, np.full(up.shape[1], quality.RIGHT), np.full(up.shape[1], quality.WRONG)
    prior = quality.PRIOR
    for _ in range(quality.ROUNDS):
        odds = np.log(share / (1 - share)) + up @ np.log(right / wrong) + down @ np.log((1 - right) / (1 - wrong))
        good = n / (1 + np.exp(-odds))
        bad = n - good
        a, a_all = good @ up + prior * quality.RIGHT, good @ (up | down) + prior
        b, b_all = bad @ up + prior * quality.WRONG, bad @ (up | down) + prior
        pooled = (a + b) / (a_all + b_all)
        worse = a / a_all < b / b_all
        then = right, wrong
        right, wrong = np.where(worse, pooled, a / a_all), np.where(worse, pooled, b / b_all)
        share = (good.sum() + prior * quality.SHARE) / (n.sum() + prior)
        if max(abs(right - then[0]).max(), abs(wrong - then[1]).max()) < quality.SETTLED:
            break
    return share, right, wrong


def test_em_equals_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = quality.measure(docs)
    rows = measured.select(quality.votes().alias("v")).groupBy("v").count().collect()
    share, right, wrong = numpy_em(np.array([r["v"] for r in rows]), [r["count"] for r in rows])
    model = quality.fit(measured)
    assert model["share"] == pytest.approx(share, abs=1e-6)
    assert np.array(model["rules"]) == pytest.approx(np.stack([right, wrong], axis=1), abs=1e-6)
    free = [x for pair in model["rules"] for x in pair]
    assert len({round(x, 4) for x in free}) > 8 and model["rules"] != [(quality.RIGHT, quality.WRONG)] * len(quality.RULES)
    # what score says is what the numpy rates say of each row
    odds = {tuple(r["v"]): None for r in rows}
    for v in odds:
        x = np.array(v)
        odds[v] = 1 / (1 + math.exp(-(math.log(share / (1 - share)) + float(np.where(x == 1, np.log(right / wrong), np.where(x == -1, np.log((1 - right) / (1 - wrong)), 0)).sum()))))
    for r in quality.score(docs).collect():
        p = odds[tuple(r["votes"])]
        assert r["p_good"] == pytest.approx(p, abs=1e-5) and r["kept"] == (not r["base_failed"] and p >= 0.5)


def test_quality_of_nothing(spark):
    df = docs_of(spark, ODD)
    assert quality.score(df.limit(0)).count() == 0 and quality.keep_good(df).columns == df.columns


def test_keep_good_judges_rows_not_ids(spark):
    good = [f"This is text number {n}, and it goes on with several other words, as texts do. It ends here, after {n * 7} words or so." for n in range(4)]
    rows = [(None, good[0], 1), (None, good[1], 1), (None, "too short", 1), (None, None, 1), (5, good[2], 1), (5, "", 1), (6, good[3], 1), (6, good[3], 1)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_words INT")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(None, good[0]), (None, good[1]), (5, good[2]), (6, good[3]), (6, good[3])])


# 10
def brute_clauses(g, text):
    """The grammar by looking around each insult and threat, without automata."""
    tokens = toxicity.TOKEN.findall(text.lower())
    known = [g.words.get(t) or g.longest(t) or ("o", 0.0) for t in tokens]
    found = Counter()
    for n, (symbol, weight) in enumerate(known):
        if symbol not in ("I", "T"):
            continue
        begin = max((k + 1 for k in range(n) if known[k][0] == "B"), default=0)
        end = min((k for k in range(n, len(tokens)) if known[k][0] == "B"), default=len(tokens))
        clause = [k for k, _ in known[begin:n]]
        negated = "N" in [k for k, _ in known[max(begin, n - toxicity.REACH) : n]]
        quoted = said = False
        for k in clause:
            if k == "Q":
                quoted, said = not quoted, False
            said |= k == "R" and not quoted
        at = "Y" in [k for k, _ in known[max(begin, n - toxicity.REACH) : n]] + [k for k, _ in known[n + 1 : min(end, n + 1 + toxicity.REACH)]]
        found[symbol + "n" * negated + "r" * (quoted or said) + "a" * at] += weight * (toxicity.AIMED if at else 1)
    return [found[k] for k in toxicity.KINDS]


def test_grammar_equals_brute_force():
    g = toxicity.Grammar({"I": {"blorp": 3.0}, "T": {"zap": 1.0}}, {"snee": 2.5, "sneezy": 4.0}, {"hardly": "N", "neighbours": "Y"})
    rng = np.random.default_rng(4)
    pool = [*"idiot kill blorp zap sneezywort sneer you they not never hardly said wrote neighbours plain word text".split(), ".", "\n", '"', ",", "a b c d e"]
    for _ in range(3000):
        text = " ".join(rng.choice(pool, rng.integers(0, 25)))
        assert g.clauses(text).tolist() == pytest.approx(brute_clauses(g, text)), text


def test_grammar_scores_clauses():
    g = toxicity.Grammar()
    of = lambda t: dict(zip(toxicity.KINDS, g.clauses(t).tolist(), strict=True))
    assert of("you are an idiot")["Ia"] > 0 and of("what a stupid plan")["I"] > 0
    assert of("you are not an idiot")["Ina"] > 0 and of("he said you are an idiot")["Ira"] > 0
    assert of('they called him "a moron" there')["Ira"] > 0 and of("I will kill you")["Ta"] > 0 and of("kill the process")["T"] > 0
    assert sum(of("not this. idiot").values()) == of("not this. idiot")["I"]
    assert not sum(of("").values()) and not sum(of("a plain text").values()) and not sum(of("die Frau und die Welt").values())
    m = toxicity.Model(g, toxicity.start_coefficients())
    value = lambda t: float(1 / (1 + np.exp(-(toxicity.features(g.clauses(t)[None]) @ m.coefficients)[0])))
    assert value("you idiot") > value("he said you idiot") > value("a plain text") and value("you idiot") > value("not an idiot")
    assert value("I will kill you") > value("kill the process") > value("a plain text")


def test_coefficients_never_turn_the_grammar_around():
    """Labels that go against the grammar bring weights down to 0, never below."""
    rng = np.random.default_rng(2)
    sums = rng.integers(0, 3, (400, len(toxicity.KINDS))).astype(float)
    for y in ((sums[:, :8].sum(axis=1) < 4).astype(float), rng.integers(0, 2, 400).astype(float), (sums.sum(axis=1) > 16).astype(float)):
        w = toxicity.logistic(toxicity.features(sums), y)
        assert (w[:-1] >= 0).all() and np.isfinite(w).all()
        one = lambda k: float((toxicity.features(np.eye(len(toxicity.KINDS))[[toxicity.KIND_AT[k]]]) @ w)[0])  # noqa: B023, E731
        for letter in "IT":
            assert one(letter) >= one(letter + "n") and one(letter + "a") >= one(letter) and one(letter + "a") >= one(letter + "ra")


def test_threats_targets_and_negations_are_learned(spark):
    rng = np.random.default_rng(9)
    fill = lambda: " ".join(f"w{x}" for x in rng.integers(0, 400, 12))
    middles = [("some blorp here", 1)] * 3 + [("surely nix blorp then", 0)] + [("we shall zap you", 1)] * 2 + [("to zap the cable", 0)] * 2 + [("nothing at all", 0)] * 4
    rows = [(f"{fill()} {middle}. {fill()}. some here we shall you surely then to the cable nix of that", toxic) for middle, toxic in middles * 80]
    learned, _, scopes = toxicity.learn(spark.createDataFrame(rows, "text STRING, toxic INT"))
    assert list(learned["I"]) == ["blorp"] and "zap" in learned["T"] and scopes["nix"] == "N"
    g = toxicity.Grammar(learned, {}, scopes)
    assert g.clauses("nix blorp")[toxicity.KIND_AT["In"]] > 0 and g.clauses("zap you")[toxicity.KIND_AT["Ta"]] > 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select(model.score(F.col("text")).alias("s"), "toxic").collect()
    bad, good = ([r["s"] >= 0.7 for r in rows if r["toxic"] == t] for t in (1, 0))
    assert sum(bad) > 0.83 * len(bad) and sum(good) <= 0.003 * len(good)


def test_toxicity_edges(spark):
    df = docs_of(spark, [*ODD, "you idiot"])
    labels = spark.createDataFrame([(0, None), (None, 1), (3, 0)], "doc_id BIGINT, toxic INT")
    model = toxicity.fit(df, labels)
    scores = [r[0] for r in df.select(model.score(F.col("text"))).collect()]
    assert len(scores) == len(ODD) + 1 and all(0 <= s <= 1 for s in scores) and max(scores) == scores[-1]
    clash = labels.unionByName(labels.withColumn("toxic", F.lit(1)))
    assert [r[0] for r in df.select(toxicity.fit(df, clash).score(F.col("text"))).collect()] == [r[0] for r in df.select(toxicity.fit(df, clash).score(F.col("text"))).collect()]
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and toxicity.drop_toxic(df.limit(0), labels.limit(0)).count() == 0


# pipeline and queries
def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        if name != "bpe":
            assert docs.columns == columns
        if name in ("toxicity", "quality", "near_dedup"):
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.where("NOT round_trip").count() == 0 and docs.count() > 0


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    good = [f"This is text number {n}, and it goes on with several other words, as texts do. It ends here, after {n * 7} words or so." for n in range(12)]
    docs = docs_of(spark, [*ODD, *good, good[0]], ["a", None]).drop("key", "copies", "h1")
    docs = docs.unionByName(docs.where("doc_id = 9"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
    assert docs.count() > 0


def test_rows_named_by_files_go_like_written_ones(spark, sf_dir, tmp_path):
    from quillon.llm.common import file_row

    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own.unionByName(own.limit(40)).unionByName(own.limit(20).withColumn("doc_id", F.lit(None).cast("bigint"))).repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert file_row(docs) is not None and file_row(spark.range(3)) is None
    assert texts(quality.keep_good(docs, row=file_row(docs))) == texts(quality.keep_good(docs))
    assert texts(neardup.keep_one(docs, row_of=file_row(docs))) == texts(neardup.keep_one(docs))


def test_every_query_runs(spark, sf_dir):
    for name, query in queries.QUERIES.items():
        rows = query(spark, sf_dir)
        assert rows.count() > 0, name


def test_intermediate_tables_can_be_discarded(spark):
    from quillon.llm import common

    kept = common.stored(spark.range(3).toDF("x"), "test")
    assert kept.count() == 3 and common.discard(spark) > 0 and common.discard(spark) == 0
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        kept.select("x").collect()
