"""Packing against the tokenizer library, a plain first fit and the rules of a packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \n\t ", "one", "x" * 50_000, "wide é ñ 世界 🎉 text", "a<|endoftext|> b<|endoftext|>", "word and word " * 4000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_first_fit(sizes, most):
    bins = []
    for item in sorted(range(len(sizes)), key=lambda x: (-sizes[x], x)):
        for items in bins:
            if sum(sizes[x] for x in items) + sizes[item] <= most:
                items.append(item)
                break
        else:
            bins.append([item])
    return bins


def held(rows, ids_of, most=1024):
    """All rules: every id in exactly one piece, checksums, gapless sequences, padding. Returns the padded length."""
    at, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r["key"] is not None, r["key"], r["start"])):
        ids = ids_of[r["key"]]
        assert r["doc_tokens"] == len(ids) and r["start"] == at.get(r["key"], 0) and r["length"] > 0
        at[r["key"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at[r["key"]]], "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {k: len(v) for k, v in ids_of.items()}
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= most
        padding += 0 if end & (end - 1) == 0 else most - end
    return padding


def test_ids_are_those_of_the_library(library, spark, sf_dir):
    coder = packing.Encoder(PATH, public_tokenizers.PATTERN)
    points = [p for p in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F300, 0x1FB00, 7)] if not 0xD800 <= p < 0xE000]
    texts = [f" a{c}b {c}{c} {c}1{c}'s 9{c}.{c} \n{c}\n {c}" for c in map(chr, points)]
    texts += [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [x or "" for x in ODD]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.encode(text).tolist() == want.ids


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 400])
def test_first_fit_decreasing_equals_the_plain_one(n):
    rng = np.random.default_rng(n)
    for top in (10, 300, 1023):
        sizes = rng.integers(1, top + 1, n)
        assert packing.first_fit_decreasing(sizes, 1024) == plain_first_fit(sizes.tolist(), 1024)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 3000])
def test_arranged_pieces_need_no_padding(n):
    sizes = np.random.default_rng(n).integers(1, 1024, n)
    got, pieces = {}, 0
    for sequence in packing.arrange(sizes, 1024):
        length = sum(x[2] for x in sequence)
        assert length == 1024 or packing.is_power(length) and length < 1024
        for item, start, count in sequence:
            got.setdefault(item, []).append((start, count))
            pieces += 1
    for item in range(n):
        ends = [0]
        for start, count in sorted(got[item]):
            assert start == ends[-1] and count > 0
            ends.append(start + count)
        assert ends[-1] == sizes[item]
    assert pieces <= 1.3 * n + 12


def test_pack_whole_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids_of = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = [r.asDict() for r in packing.pack(docs, PATH, public_tokenizers.PATTERN, group=64).collect()]
    assert held(rows, ids_of) == 0 and len({r["sequence_id"] >> 32 for r in rows}) > 2
    got = queries.op13_first_fit_packing(spark, sf_dir)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.agg(F.sum("length")).first()[0] == sum(map(len, ids_of.values()))
    read = packing.sequences(docs, PATH, public_tokenizers.PATTERN, group=64)
    assert read.agg(F.sum("padding"), F.sum("length")).first() == (0, sum(map(len, ids_of.values())))


def test_pack_odd_rows(spark, library):
    rows = [(str(n), t, 5, "s") for n, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id STRING, text STRING, row INT, `group` STRING")
    ids_of = {str(n): [*library.encode(t or "", add_special_tokens=False).ids, 0] for n, t in enumerate(ODD)}
    for most in (1, 8, 1024):
        assert held([r.asDict() for r in packing.pack(docs, PATH, public_tokenizers.PATTERN, most=most, group=3).collect()], ids_of, most) == 0
    assert packing.pack(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    again = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("string")))
    assert packing.pack(again, PATH, public_tokenizers.PATTERN, group=3).agg(F.sum("length")).first()[0] == 3 * sum(map(len, ids_of.values()))
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(docs, PATH, public_tokenizers.PATTERN, most=1000)


def test_wide_vocabularies_keep_their_ids():
    assert packing.checksum(np.array([70_000, 1], np.uint32)) == zlib.crc32(np.array([70_000, 1], "<u4").tobytes())
