"""Packing documents into sequences: first-fit decreasing with a tournament tree of free capacities, in randomised groups.

A document's tokens are the ids of its whole text and an end id. Its first tokens fill whole sequences as far as they go; the
rest is an item of fewer than ``most`` tokens. Rows are dealt to groups at random, some thousands to a group, so that a group is a
sample of all lengths and its ids fit a task, whatever document, source or copy is frequent. In a group, items go in order of
size to the first bin that has room; a tree whose nodes hold the most room below them finds it in logarithmic time.

Pieces may be cut. So bins that are not full give their place to the fullest ones among them: the least filled bins are taken
apart, and their pieces, cut where need be, fill the others. The one bin that stays open is cut into lengths that are powers
of two, which need no padding. Nearly all items stay whole.

Texts are encoded once: what is written between the two steps are document lengths, checksums of whole sequences and the ids of
items, two bytes each as long as the vocabulary allows. Ids of whole sequences are never shuffled.

Nulls and empty texts are documents of the end id alone. Very long texts are encoded whole and become many sequences. Rows are
packed one by one, so null and repeated keys and repeated rows are as good as others; ties of size go by row. An empty table
gives an empty result. Only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import byte_characters
from quillon.llm.common import small_batches, stored

#: Rows of a group, on average: their items are some megabytes.
GROUP = 4096


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them for a byte-level BPE file, without special tokens being added.

    The file's vocabulary is read as ranks, which another encoder walks several times faster; its ids are the same (tests walk through
    the code points and whole tables with both libraries).
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in piece): n for piece, n in model["model"]["vocab"].items() if piece not in special}
        self.coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.size = 1 + max([*ranks.values(), *special.values()])

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; a special token's string in it is that token, as in the library."""
        return self.coder.encode_to_numpy(text, allowed_special="all", disallowed_special=())


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


def encoded(docs: DataFrame, path: str, pattern: str, key: Column, text: Column, most: int, end: int = 0) -> DataFrame:
    """``row, key, tokens, sums, item``: a document's length with the end id, the checksums of its whole sequences, and the ids of what is left over as bytes."""
    kind = docs.select(key.alias("key")).schema["key"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        small = np.dtype("<u2" if max(coder.size, end + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            tokens, sums, items = [], [], []
            for value in batch.column("text"):
                ids = np.append(coder.encode(value.as_py() or ""), np.uint32(end))
                whole = len(ids) - len(ids) % most
                tokens.append(len(ids))
                sums.append([checksum(ids[a : a + most]) for a in range(0, whole, most)])
                items.append(ids[whole:].astype(small).tobytes())
            out = [batch.column("row"), batch.column("key"), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(items, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["row", "key", "tokens", "sums", "item"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("key"), text.cast("string").alias("text"))
    return rows.mapInArrow(apply, f"row BIGINT, key {kind}, tokens BIGINT, sums ARRAY<BIGINT>, item BINARY")


class Room:
    """A tournament tree over bins: each node holds the most room of the bins below it."""

    def __init__(self, bins: int, most: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [most] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken off there."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        found = at - self.leaves
        best[at] -= size
        while at > 1:
            at //= 2
            left, right = best[2 * at], best[2 * at + 1]
            best[at] = left if left > right else right
        return found


def first_fit_decreasing(sizes: np.ndarray, most: int) -> list[list[int]]:
    """The items of each bin, bins in order of opening. Sizes are from 1 to ``most``; ties keep their order."""
    # two neighbouring bins hold more than ``most`` together, so these bins are enough
    room, bins = Room(min(len(sizes), int(2 * sizes.sum() // most) + 2), most), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        at = room.first_fit(int(sizes[item]))
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def is_power(n: int) -> bool:
    """Whether a length needs no padding beside a full one."""
    return n & (n - 1) == 0


def arrange(sizes: np.ndarray, most: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, from, length): first-fit decreasing, then the open bins filled up from the least filled ones."""
    done, open_ = [], []
    for items in first_fit_decreasing(sizes, most):
        pieces = [(x, 0, int(sizes[x])) for x in items]
        length = sum(n for _, _, n in pieces)
        (done if length == most or is_power(length) else open_).append((length, pieces))
    out = [pieces for _, pieces in done]
    open_.sort(key=lambda x: -x[0])
    first, spare = 0, []  # pieces of bins that were taken apart, the next one last
    while first < len(open_):
        length, pieces = open_[first]
        first += 1
        while length < most and (spare or first < len(open_)):
            if not spare:
                spare = open_.pop()[1]
            item, start, n = spare.pop()
            fits = min(n, most - length)
            pieces.append((item, start, fits))
            length += fits
            if fits < n:
                spare.append((item, start + fits, n - fits))
        if length == most:
            out.append(pieces)
        else:
            spare = pieces[::-1]
    while spare:  # the last open bin, or what was left of one: its binary digits
        left = sum(n for _, _, n in spare)
        want, pieces = min(most, 1 << (left.bit_length() - 1)), []
        while want:
            item, start, n = spare.pop()
            fits = min(n, want)
            pieces.append((item, start, fits))
            want -= fits
            if fits < n:
                spare.append((item, start + fits, n - fits))
        out.append(pieces)
    return out


def _pack(group: pa.Table, most: int) -> pa.Table:
    """The pieces of a group's documents."""
    group = group.sort_by("row")
    number = group.column("group")[0].as_py() << 32 if len(group) else 0
    keys, tokens, sums = (group.column(x).to_pylist() for x in ("key", "tokens", "sums"))
    whole = np.array([len(x) for x in sums], np.int64) * most
    sizes = np.array(tokens, np.int64) - whole
    items = group.column("item").to_pylist()
    width = next((len(x) // int(n) for x, n in zip(items, sizes, strict=True) if n), 2)
    items = [np.frombuffer(x, f"<u{width}") for x in items]
    rows = [(n, k * most, most, crc, 0) for n, x in enumerate(sums) for k, crc in enumerate(x)]
    ids = list(range(len(rows)))
    present = np.flatnonzero(sizes)
    for pieces in arrange(sizes[present], most):
        offset, sequence = 0, ids[-1] + 1 if ids else 0
        for x, start, n in pieces:
            doc = int(present[x])
            rows.append((doc, int(whole[doc]) + start, n, checksum(items[doc][start : start + n]), offset))
            ids.append(sequence)
            offset += n
    doc, start, length, crc, offset = ([r[c] for r in rows] for c in range(5))
    long = lambda x: pa.array(x, pa.int64())
    columns = [pa.array([keys[d] for d in doc], group.schema.field("key").type), long(start), long(length), long(crc), long([tokens[d] for d in doc]), long([number + s for s in ids]), long(offset)]
    return pa.Table.from_arrays(columns, ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", most: int = 1024, end: int = 0, group: int = GROUP, seed: int = 13) -> DataFrame:
    """Every piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``. ``path`` is a ``tokenizers`` file of a byte-level BPE, ``pattern`` what splits its pre-tokens."""
    if most < 1 or is_power(most) is False:
        raise ValueError("the length of a sequence is a power of two")
    rows = stored(encoded(docs, path, pattern, F.col(key), F.col(text), most, end), "pack-ids")
    groups = max(1, -(-rows.count() // group))
    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    shape = f"key {kind}, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"
    return dealt.groupBy("group").applyInArrow(lambda table: _pack(table, most), shape)


def sequences(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", most: int = 1024, **options: int) -> DataFrame:
    """``sequence_id, length, padding, pieces``: what a loader reads; pieces are in order of their offset."""
    packed = pack(docs, path, pattern, key, text, most, **options)
    piece = F.struct("offset", F.col("key"), "start", "length", "doc_tokens")
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    power = F.call_function("bit_count", F.col("length")) == 1
    return per.select("sequence_id", "length", F.when(power, F.lit(0)).otherwise(F.lit(most) - F.col("length")).cast("long").alias("padding"), "pieces")
