"""Source divergence audit: how the terms of each source of a language differ from other sources and from the whole language.

Terms are counted in tasks by (language, source), so a frequent source or word makes a few rows for each task. A language keeps the terms
of at least ``least_docs`` of its documents. The kept terms of a language are dealt to chunks by hash, and there encoded as integers:
the chunk's sorted term array gives each term an id by searchsorted, and a bincount over (source, id) gives every source a dense
vector. Ids follow the UTF-8 order of the terms, so equal values fall to the smaller id. Chunks return sums for pairs of sources and
their best terms, never vectors; a chunk's vectors and its pairs have a bounded size, whatever the number of terms and sources.

All numbers are integers: p = 1 + floor(scale * (count + 1) / (N + V)), N the sum of the group's counts over the V kept terms, and
f(p, q) = floor((p - q)^2 / q). The division by N + V goes in two steps, exact up to N + V = 9 * 10^13.

Null texts, languages and sources are empty strings; groups of documents without terms count, with N = 0, and a language without kept
terms has pairs of value 0 and no terms. Very long texts are counted whole. Repeated rows are documents of their own. Ties go by the
item in UTF-8 order. An empty table gives an empty result. Only the three columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, UPPER, small_batches, stored

#: Distinct (language, source, term) entries that a task holds before it passes them on.
ENTRIES = 300_000
#: Cells of a chunk's vectors, and pairs of sources of a task.
CELLS, PAIRS = 1 << 16, 1 << 20
#: Parts of the scale, whose product it is.
SCALE = (10_000, 100_000)

#: Bytes of terms: letters, in lower case, and all beyond ASCII; others separate terms.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term and the documents that hold it, summed over parts of the documents: a group and term may come several times."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        inside: dict[tuple[str, str], Counter] = defaultdict(Counter)
        names = ["lang", "source", "term", "n", "docs"]

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in counts.items():
                docs, n = inside[lang, source], len(terms)
                columns = [pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(terms.keys(), pa.binary()), pa.array(terms.values(), pa.int64()), pa.array(map(docs.__getitem__, terms), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
            counts.clear()
            inside.clear()

        held = 0
        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for group, value in zip(groups, batch.column("text"), strict=True):
                terms = value.as_py().translate(_TABLE).split()
                own = counts[group]
                held -= len(own)
                own.update(terms)
                held += len(own)
                inside[group].update(set(terms))
                if held > ENTRIES:
                    yield from passed()
                    held = 0
        yield from passed()

    small_batches(docs.sparkSession)
    rows = docs.select(_filled(lang, "lang"), _filled(source, "source"), _filled(text, "text").cast("binary").alias("text"))
    return rows.mapInArrow(apply, "lang STRING, source STRING, term BINARY, n BIGINT, docs BIGINT")


def _filled(column: str, name: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(name)


def share(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """p of counts in a group of ``total`` occurrences with ``kept`` terms."""
    whole = total + kept
    first, rest = np.divmod((counts + 1) * SCALE[0], whole)
    return 1 + first * SCALE[1] + rest * SCALE[1] // whole


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of two shares; each is at most 10^9 + 1, so that the square fits 64 bits."""
    return (p - q) ** 2 // q


def binned(cells: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Sums of counts by cell. A bincount adds up floats, so high and low halves of the counts are added apart, each exactly."""
    low, high = (np.bincount(cells, weights=x, minlength=size).astype(np.int64) for x in (counts & 0xFFFFFFFF, counts >> 32))
    return (high << 32) + low


def _chunk(groups: pa.Table, counts: pa.Table, top: int) -> pa.Table:
    """Of one chunk of a language: the sums of pairs, and the best terms, for the sources of one block."""
    lang, kept = groups.column("lang")[0], groups.column("kept")[0].as_py()
    groups = groups.sort_by("source")
    names = np.array(groups.column("source").to_pylist(), object)
    total = groups.column("total").to_numpy()[:, None]
    own = np.flatnonzero(groups.column("own").to_numpy(zero_copy_only=False))
    spelled = np.array(counts.column("term").to_pylist(), object)
    terms = np.unique(spelled)  # bytes, so in UTF-8 order
    ids = np.searchsorted(terms, spelled)
    place = {name: n for n, name in enumerate(names.tolist())}
    sources = np.array([place[s] for s in counts.column("source").to_pylist()], np.int64)
    dense = binned(sources * len(terms) + ids, counts.column("n").to_numpy(), len(names) * len(terms)).reshape(len(names), len(terms))
    p = share(dense, total, kept)
    whole = share(dense.sum(axis=0), int(total.sum()), kept)
    out: list[tuple] = []
    for a in own.tolist():
        for b in range(len(names)):
            if a != b:
                out.append((names[a], "pair", names[b].encode(), int(apart(p[a], p[b]).sum())))
        more = np.flatnonzero((dense[a] > 0) & (p[a] > whole))
        values = apart(p[a][more], whole[more])
        for n in np.lexsort((more, -values))[:top].tolist():
            out.append((names[a], "term", terms[more[n]], int(values[n])))
    columns = list(zip(*out, strict=True)) or [()] * 4
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
    arrays = [pa.array([lang.as_py()] * len(out), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
    return pa.Table.from_arrays(arrays, ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` compares a source with each other one of its language, part ``term`` has its ``top`` terms above the language's share."""
    # one shuffle by term: the sums of each source, and the documents of all sources beside them
    counts = term_counts(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = counts.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    kept = stored(spread.where(F.col("docs") >= least_docs).select("lang", "term", "source", "n"), "kept-terms")
    vocabulary = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("one").alias("kept"))
    groups = docs.select(_filled(lang, "lang"), _filled(source, "source")).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"])
    groups = stored(groups.join(vocabulary, "lang", "left").na.fill(0, ["kept"]), "audit-groups")

    # chunks of terms, so that sources x terms fit; blocks of sources, so that the pairs of a task fit
    sizes = groups.groupBy("lang", "kept").agg(F.count(F.lit(1)).alias("sources")).where("kept > 0")
    sizes = sizes.select("lang", F.ceil(F.col("kept") * F.col("sources") / CELLS).alias("chunks"), F.ceil(F.col("sources") * F.col("sources") / PAIRS).alias("blocks"))
    whole = groups.join(sizes, "lang")
    whole = whole.withColumn("home", F.pmod(F.xxhash64("source"), F.col("blocks"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    whole = whole.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("own", F.col("home") == F.col("block"))
    dealt = kept.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["lang", "chunk", "block"]
    shape = "lang STRING, source STRING, part STRING, item BINARY, value BIGINT"
    left = whole.select(*key, "source", "total", "kept", "own").groupBy(*key)
    found = left.cogroup(dealt.select(*key, "term", "source", "n").groupBy(*key)).applyInArrow(lambda a, b: _chunk(a, b, top) if len(a) and len(b) else _chunk_of_none(), shape)
    found = stored(found, "audit-parts")

    none = groups.where("kept = 0").select("lang", "source")
    others = none.withColumnRenamed("source", "item")
    empty = none.join(others, "lang").where("source != item").select("lang", "source", F.lit("pair").alias("part"), F.col("item").cast("binary").alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(empty)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best).withColumn("item", F.col("item").cast("string"))


def _chunk_of_none() -> pa.Table:
    """A chunk that no term fell to."""
    kinds = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.binary(), "value": pa.int64()}
    return pa.Table.from_arrays([pa.array([], k) for k in kinds.values()], list(kinds))


#: DuckDB's form of ``audit`` over documents.
AUDIT_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, s.v
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS HUGEINT) AS p FROM dense
), whole AS (
  SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (c + 1) // (sum(c) OVER (PARTITION BY lang) + v) AS HUGEINT) AS q
  FROM (SELECT lang, term, v, CAST(sum(n) AS HUGEINT) AS c FROM dense GROUP BY lang, term, v)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM sizes)
), terms AS (
  SELECT a.lang, a.source, 'term' AS part, a.term AS item, CAST((a.p - w.q) * (a.p - w.q) // w.q AS BIGINT) AS value
  FROM shares a JOIN whole w ON a.lang = w.lang AND a.term = w.term WHERE a.n > 0 AND a.p > w.q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
