"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank vocabulary.

The vocabulary's byte strings become pieces over 256 stand-in characters (one per byte), scored by negative rank; the
normaliser is the identity. sentencepiece then merges, in each pre-token, the adjacent pair with the lowest rank first,
which is what a byte-level BPE does. Decoding is the inverse mapping from ids to bytes.

Nulls and empty texts: no ids (an empty array), decoded to an empty string of bytes. Very long texts: encoded whole,
pre-token by pre-token. Ties and repeated rows: every row is encoded by itself. Extra columns pass through; input
columns named like the outputs are replaced, and the caller can choose other names. Empty tables: an empty result.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillon.llm.common import free_name, small_batches

#: Pre-tokens whose ids a worker remembers; the memory is cleared when full, so its size is bounded.
MEMORY = 400_000
#: Texts whose unknown pre-tokens are encoded in one call.
TOGETHER = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of the bytes, a space and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def byte_characters() -> list[str]:
    """A character for each byte: the visible Latin-1 ones stand for themselves, the others for U+0100 and up, in order of the byte."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in set(seen))}
    return [chr(hidden.get(b, b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of the protobuf wire format: bytes are length-delimited, floats fixed 32-bit, integers varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of these ranks; piece ``i`` is the byte string of rank ``i``, and the unknown piece follows them.

    Field numbers and enumeration values are those of the public ``sentencepiece_model.proto``.
    """
    letters = byte_characters()
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        text = "".join(letters[b] for b in token).encode()
        pieces[rank] = _field(1, _field(1, text) + _field(2, -float(rank)))
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normaliser)


def plain_pattern(pattern: str) -> str:
    """``pattern`` with the Unicode classes \\p{L}, \\p{N} and \\s written out as ranges, for the standard library's faster engine."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": [], "s": []}
    spaces = {0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(9, 14), 32, *range(0x2000, 0x200B)}
    for point in range(sys.maxunicode + 1):
        kind = "s" if point in spaces else unicodedata.category(chr(point))[0]
        if kind in ranges:
            if ranges[kind] and ranges[kind][-1][1] == point - 1:
                ranges[kind][-1][1] = point
            else:
                ranges[kind].append([point, point])
    inner = {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in ranges.items()}
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern, re.DOTALL):
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            chars = inner[part[3] if part[1] == "p" else "s"]
            out.append(chars if inside else f"[{chars}]")
        elif part == r"\S":
            if inside:
                raise ValueError("\\S inside a class isn't supported")
            out.append(f"[^{inner['s']}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


class Codec:
    """Encodes and decodes texts; made once per Python worker from the broadcast model and ranks."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import sentencepiece

        self.find = re.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = tokens
        self.ranks = {t: n for n, t in enumerate(tokens)}
        self.letters = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode pre-tokens in one call; a pre-token that is a vocabulary entry is that entry."""
        fresh = []
        for text in pieces:
            whole = self.ranks.get(text.encode())
            if whole is None:
                fresh.append(text)
            else:
                self.known[text] = array("i", (whole,)).tobytes()
        mapped = [x.encode().decode("latin-1").translate(self.letters) for x in fresh]
        for text, ids in zip(fresh, self.model.encode(mapped, num_threads=1), strict=True):
            self.known[text] = array("i", ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts as int32; unknown pre-tokens of a group of texts are encoded together."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            pieces = [self.find(x or "") for x in texts[at : at + TOGETHER]]
            own = set().union(*pieces)
            missing = own.difference(self.known)
            if len(self.known) + len(missing) > MEMORY:
                self.known.clear()
                missing = own
            self.learn(missing)
            ids = self.known.__getitem__
            out += [np.frombuffer(b"".join(map(ids, x)), np.intc) for x in pieces]
        return out

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of rows of ids."""
        token = self.tokens.__getitem__
        return [b"".join(map(token, ids.tolist())) for ids in rows]


_codecs: dict[int, Codec] = {}


class Tokenizer:
    """The operator: ``encode`` and ``decode`` as columns. The model (about 1 MB, set by the vocabulary, not by the data) is broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        small_batches(spark)
        self.shipped = spark.sparkContext.broadcast((serialise(ranks), sorted(ranks, key=ranks.get), plain_pattern(pattern)))

    def _codec(self):
        shipped = self.shipped

        def codec() -> Codec:
            if shipped.value[0] not in _codecs:
                _codecs.clear()
                _codecs[shipped.value[0]] = Codec(*shipped.value)
            return _codecs[shipped.value[0]]

        return codec

    def encode(self, text: Column) -> Column:
        """array<int> of the whole text's ids; of a null text, none."""
        codec = self._codec()
        return arrow_udf(lambda texts: _lists(codec().encode(texts.to_pylist())), "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that the ids stand for; of null, none."""
        codec = self._codec()

        def apply(rows: pa.Array) -> pa.Array:
            values, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
            return pa.array(codec().decode([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]), pa.binary())

        return arrow_udf(apply, "binary")(ids)

    def round_trip(self, text: Column) -> Column:
        """struct<ids, decoded>: a text's ids and what these decode to, in one pass. (``decode(encode(x))`` beside ``encode(x)`` encodes twice, because Spark fuses chained Python functions.)"""
        codec = self._codec()

        def apply(texts: pa.Array) -> pa.Array:
            ids = codec().encode(texts.to_pylist())
            return pa.StructArray.from_arrays([_lists(ids), pa.array(codec().decode(ids), pa.binary())], ["ids", "decoded"])

        return arrow_udf(apply, "struct<ids: array<int>, decoded: binary>")(text)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.intc)])))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text and the bytes that the ids decode to."""
    both = free_name(docs, "coded")
    coded = docs.withColumn(both, Tokenizer(docs.sparkSession, path, pattern).round_trip(F.col(text)))
    return coded.withColumn(ids, F.col(both)["ids"]).withColumn(decoded, F.col(both)["decoded"]).drop(both)
