"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Sketch: each whole text becomes its set of word shingles (64-bit hashes), a 128-bit fingerprint of the set and a MinHash
   signature. Texts with equal fingerprints form one class; from here on a class is one node, so copies cost nothing more.
2. Candidates: signatures are cut into bands; nodes that agree on a band share a bucket. Instead of all pairs of a bucket,
   each node is paired with the bucket's leader, a pseudo-random node that differs from band to band.
3. Sequential Bayesian test: signatures are compared batch by batch; a pair goes as soon as the posterior probability that
   its similarity reaches the threshold, given the matches so far under a uniform prior, falls below ``doubt``.
4. Survivors are verified exactly on their full sets, the best pair of each node first; pairs inside a component that is
   connected by then add nothing and are skipped.
5. Buckets whose nodes still lie in several components are compared in blocks: nodes outside the bucket's largest component
   against all of its nodes, inside tasks, by the test and then exactly; tasks emit verified links alone, one for a node and
   a component. So every pair of a bucket that could still join two components is tested, and no group is expanded.

Bands are as many as it takes to miss a pair at the threshold with probability ``miss`` at most.

Null, empty and blank texts have an empty set, linked with nothing. Texts with fewer words than a shingle have their whole
sequence as the one shingle. Very long texts are sketched whole. Repeated rows fall into one class. Ties between ids can't
matter: a component's id is its smallest id. Null ids sort behind all others; a component of null ids alone has a null id.
An empty table gives an empty result. Extra columns aren't carried by ``components``; ``keep_one`` keeps its input's columns
and decides by row, not by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quillon.llm.common import cut, free_name, small_batches, stored

#: Word hashes that a Python worker remembers; cleared when full.
MEMORY = 400_000
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX1, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Settings:
    """``shingle`` words; similarity of ``percent`` / 100; signature rows in a band; probabilities of missing a pair by bands and by the test."""

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-6
    doubt: float = 1e-6
    batch: int = 25

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def least(self) -> list[tuple[int, int]]:
        """For each number of compared rows, the matches below which a pair goes.

        With a uniform prior, the similarity after m matches in n rows is Beta(m + 1, n - m + 1) distributed; its
        probability above t is that of at most m successes in n + 1 trials of chance t.
        """
        t, out = self.percent / 100, []
        for n in sorted({*range(self.batch, self.size, self.batch), self.size}):
            tail, m = 0.0, 0
            while m <= n:
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if tail >= self.doubt:
                    break
                m += 1
            out.append((n, m))
        return out


class Sketcher:
    """Shingle sets and signatures of single texts, in a Python worker."""

    def __init__(self, settings: Settings):
        from xxhash import xxh64_intdigest

        self.hash, self.known, self.settings = xxh64_intdigest, {}, settings
        draw = np.random.default_rng(20_240_501)
        self.times = draw.integers(1, 1 << 63, settings.size, dtype=np.uint64) | np.uint64(1)
        self.flips = draw.integers(0, 1 << 63, settings.size, dtype=np.uint64)

    def words(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        w, k = self.words(text), self.settings.shingle
        if not len(w):
            return w
        width = min(k, len(w))
        out = np.full(len(w) - width + 1, 0 if width == k else len(w), np.uint64)
        for j in range(width):
            out = (out + w[j : len(w) - width + 1 + j]) * MIX1
            out ^= out >> np.uint64(32)
        out *= MIX2
        out ^= out >> np.uint64(29)
        return np.unique(out)

    @staticmethod
    def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
        """128 bits that depend on the set alone."""
        a = (shingles * MIX3) ^ (shingles >> np.uint64(31))
        b = (shingles ^ MIX1) * MIX2
        b ^= b >> np.uint64(33)
        with np.errstate(over="ignore"):
            return int((a * a * MIX1 + a).sum(dtype=np.uint64).view(np.int64)), int((b * MIX3).sum(dtype=np.uint64).view(np.int64))

    def signature(self, shingles: np.ndarray) -> bytes:
        """Low 16 bits of the minimum under each of the hash functions."""
        least = np.full(self.settings.size, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            part = (shingles[at : at + 2048, None] ^ self.flips) * self.times
            np.minimum(least, (part >> np.uint64(32)).min(axis=0), out=least)
        return (least & np.uint64(0xFFFF)).astype("<u2").tobytes()


def sketch(docs: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, h1, h2, signature`` of each row; no signature for empty sets."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    @pandas_udf("n_shingles bigint, h1 bigint, h2 bigint, signature binary")
    def sketched(column: pd.Series) -> pd.DataFrame:
        own, out = Sketcher(settings), []
        for text in column:
            s = own.shingles(text)
            out.append((len(s), *own.fingerprint(s), own.signature(s) if len(s) else None))
        return pd.DataFrame(out, columns=["n_shingles", "h1", "h2", "signature"])

    small_batches(docs.sparkSession, 2000)
    return rows.select("key", sketched("text").alias("s")).select(F.col("key").cast(kind), "s.*")


def matches(settings: Settings):
    """Column function: matching signature rows of two signatures, or null as soon as the Bayesian test rules the pair out."""
    least = settings.least()

    @pandas_udf("int")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="Int32")
        left, right = (np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1) for x in (a, b))
        alive, got, before = np.arange(len(a)), np.zeros(len(a), int), 0
        for n, m in least:
            got[alive] += (left[alive, before:n] == right[alive, before:n]).sum(axis=1)
            alive, before = alive[got[alive] >= m], n
        out = pd.Series(pd.NA, index=range(len(a)), dtype="Int32")
        out.iloc[alive] = got[alive]
        return out

    return count


def buckets(classes: DataFrame, settings: Settings) -> DataFrame:
    """``band, bucket, node`` for each band of each node."""
    width = 2 * settings.rows
    values = F.transform(F.sequence(F.lit(0), F.lit(settings.bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * width + 1, F.lit(width))))
    return classes.select(F.posexplode(values).alias("band", "bucket"), "node", "size")


def star_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs of a bucket's leader ``a`` and another node ``b``. The leader is the least node after flipping bits by the bucket's hash."""
    flip = F.col("bucket").bitwiseAND(F.lit((1 << 62) - 1))
    led = members.groupBy("bucket").agg(F.min(F.col("node").bitwiseXOR(flip)).alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    led = led.select("bucket", F.col("least").bitwiseXOR(flip).alias("a"))
    return members.join(led, "bucket").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()


def with_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    own = classes.select("node", "signature")
    return pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")


def shingle_sets(docs: DataFrame, wanted: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """``node, shingles`` (sorted 64-bit hashes as bytes) of wanted nodes, again from the whole texts; only texts of wanted nodes are moved."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    ids = wanted.select(F.col("first").alias("first_key")).distinct()
    rows = rows.join(ids, F.col("key").eqNullSafe(F.col("first_key")), "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Sketcher(settings)
        for batch in batches:
            made = [own.shingles(x) for x in batch.text]
            yield pd.DataFrame([(*own.fingerprint(s), s.tobytes()) for s in made], columns=["h1", "h2", "shingles"])

    found = rows.select("text").mapInPandas(sets, "h1 bigint, h2 bigint, shingles binary")
    return found.join(wanted.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "shingles").dropDuplicates(["node"])


def similar_sets(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity; sizes that can't are told apart at once."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    percent = settings.percent

    @pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar_sets(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    own = sets.select("node", "shingles")
    return pairs.join(own.toDF("a", "xa"), "a").join(own.toDF("b", "xb"), "b").where(similar("xa", "xb")).select("a", "b")


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes with an edge. Each round hooks every node to its least neighbour under the round's hash and contracts; a tree of n nodes shrinks by a constant share."""
    edges = cut(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct().withColumn("root", F.col("node"))
    number = 0
    while not edges.isEmpty():
        number += 1
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        rank = lambda c, n=number: F.xxhash64(F.lit(n), F.col(c))
        hooks = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("best"))
        hooks = hooks.select(F.col("a").alias("from"), F.when(F.struct(rank("a"), F.col("a")) < F.col("best"), F.col("a")).otherwise(F.col("best.to")).alias("to"))
        # pointer jumping: each hook is followed three times more
        first = cut(hooks)
        hooks, onwards = first, first.select(F.col("from").alias("to"), F.col("to").alias("far"))
        for _ in range(3):
            hooks = hooks.join(onwards, "to", "left").select("from", F.coalesce("far", "to").alias("to"))
        hooks = cut(hooks)
        labels = cut(labels.join(hooks.withColumnRenamed("from", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left, right = hooks.toDF("a", "ra"), hooks.toDF("b", "rb")
        edges = edges.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where(F.col("a") != F.col("b"))
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` with more edges: only the components that these join are worked on."""
    more = connected(apart(edges, labels)).toDF("root", "onto")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(labels, "node", "left_anti").withColumn("root", F.col("node"))
    return cut(labels.union(ends).join(more, "root", "left").select("node", F.coalesce("onto", "root").alias("root")))


def labelled(df: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``df`` with the component ``name`` of ``column``; a node without edges is its own."""
    return df.join(labels.select(F.col("node").alias(column), F.col("root").alias("root_")), column, "left").withColumn(name, F.coalesce("root_", column)).drop("root_")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components, as pairs of components ``a, b``."""
    both = labelled(labelled(pairs.select("a", "b"), "a", labels, "ra"), "b", labels, "rb")
    return both.where(F.col("ra") != F.col("rb")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


#: Rows of a block's two sides, and bytes of sets on each side.
LEFT, RIGHT, BYTES = 512, 1024, 16 << 20


def deal(members: DataFrame, labels: DataFrame, least: int, with_sets: bool) -> DataFrame:
    """Nodes of buckets of ``least`` and more that hold several components, dealt into blocks.

    Nodes outside the bucket's largest component stand on the left of blocks, all nodes on the right: a bucket of n nodes,
    k of them outside, makes about n * k / LEFT + k * n / RIGHT rows, and n rows where k is small. ``with_sets`` also bounds a
    block's sides by the bytes of their shingle sets.
    """
    rows = labelled(members, "node", labels, "part").withColumn("bytes", F.col("size") * 8 if with_sets else F.lit(0).cast("long"))
    parts = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    mixed = parts.groupBy("bucket").agg(F.sum("n").alias("all"), F.sum("b").alias("all_bytes"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "part", "b")).alias("most"))
    mixed = mixed.where((F.col("parts") > 1) & (F.col("all") >= least))
    mixed = mixed.select("bucket", "all", "all_bytes", F.col("most.part").alias("main"), (F.col("all") - F.col("most.n")).alias("others"), (F.col("all_bytes") - F.col("most.b")).alias("others_bytes"))
    rows = rows.join(mixed, "bucket")
    lefts = F.ceil(F.greatest(F.col("others") / LEFT, F.col("others_bytes") / BYTES)).cast("int")
    rights = F.ceil(F.greatest(F.col("all") / RIGHT, F.col("all_bytes") / BYTES)).cast("int")
    hashed, same = F.xxhash64("node"), ["bucket", "band", "node", "part"]
    as_right = rows.select(*same, F.explode(F.sequence(F.lit(0), lefts - 1)).alias("l"), F.pmod(hashed, rights).cast("int").alias("r"), F.lit(0).alias("side"))
    as_left = rows.where(F.col("part") != F.col("main")).select(*same, F.pmod(hashed, lefts).cast("int").alias("l"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("r"), F.lit(1).alias("side"))
    return as_right.unionByName(as_left)


def passing(block: pd.DataFrame, settings: Settings, least: list[tuple[int, int]]) -> Iterator[tuple[pd.Series, pd.DataFrame, np.ndarray]]:
    """For each left row: the right rows of other components that pass the Bayesian test, and their matches. A pair is looked at in the first band that it agrees on."""
    right, left = (block[block.side == s] for s in (0, 1))
    if not len(right) or not len(left):
        return
    signs, parts, band = np.frombuffer(b"".join(right.signature), "<u2").reshape(len(right), -1), right.part.to_numpy(), int(left.band.iloc[0])
    for own in left.itertuples(index=False):
        mine = np.frombuffer(own.signature, "<u2")
        alive = np.flatnonzero(parts != own.part)
        got, before = np.zeros(len(signs), int), 0
        for n, m in least:
            got[alive] += (signs[alive, before:n] == mine[before:n]).sum(axis=1)
            alive, before = alive[got[alive] >= m], n
        if len(alive):
            agree = (signs[alive] == mine).reshape(len(alive), settings.bands, settings.rows).all(axis=2)
            alive = alive[agree.argmax(axis=1) == band]
        if len(alive):
            yield own, right.iloc[alive], got[alive]


def by_blocks(dealt: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each block's rows; blocks are shuffled together, sorted and streamed, one in memory at a time."""
    dealt = dealt.repartition("bucket", "l", "r").sortWithinPartitions("bucket", "l", "r", "side")
    names = [c.split()[0] for c in schema.split(", ")]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            ids = held.groupby(["bucket", "l", "r"], sort=False).ngroup().to_numpy()
            done, held = held[ids < ids[-1]], held[ids == ids[-1]]
            out = sorted({x for _, block in done.groupby(["bucket", "l", "r"], sort=False) for x in work(block)})
            yield pd.DataFrame(out, columns=names, dtype="int64")
        if held is not None:
            yield pd.DataFrame(sorted(set(work(held))), columns=names, dtype="int64")

    return dealt.mapInPandas(blocks, schema)


def nodes_to_verify(members: DataFrame, labels: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Nodes of mixed buckets that pass the test with a node of another component."""
    least = settings.least()

    def work(block: pd.DataFrame) -> set[tuple[int]]:
        found = set()
        for own, others, _ in passing(block, settings, least):
            found |= {(own.node,), *((x,) for x in others.node)}
        return found

    # the pair of a bucket of two is a star pair
    return by_blocks(deal(members, labels, 3, False).join(classes.select("node", "signature"), "node"), work, "node bigint").distinct()


def block_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Verified links between components inside mixed buckets, the best pairs first; a node needs one link to a component."""
    least, percent = settings.least(), settings.percent

    def work(block: pd.DataFrame) -> set[tuple[int, int]]:
        found = set()
        for own, others, matched in passing(block, settings, least):
            mine, joined = np.frombuffer(own.shingles, np.uint64), set()
            nodes, parts, theirs = others.node.tolist(), others.part.tolist(), others.shingles.tolist()
            for at in np.argsort(-matched, kind="stable").tolist():
                if parts[at] not in joined and similar_sets(mine, np.frombuffer(theirs[at], np.uint64), percent):
                    joined.add(parts[at])
                    found.add((min(own.node, nodes[at]), max(own.node, nodes[at])))
        return found

    # two open nodes may be all that is left of a larger bucket
    rows = deal(members, labels, 2, True).join(classes.select("node", "signature"), "node").join(sets.select("node", "shingles"), "node")
    return by_blocks(rows, work, "a bigint, b bigint").distinct()


def components(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row."""
    settings = settings or Settings()
    sketched = stored(sketch(docs, settings, key, text), "sketches")
    classes = sketched.where(F.col("n_shingles") > 0).groupBy("h1", "h2").agg(F.min("key").alias("first"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = buckets(classes, settings)
    test = matches(settings)
    stars = with_signatures(star_pairs(members), classes).withColumn("matched", test("sa", "sb")).where(F.col("matched").isNotNull())
    stars = stored(stars.select("a", "b", "matched"), "stars")
    nodes = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    sets = stored(shingle_sets(docs, classes.join(nodes, "node"), settings, key, text), "sets")
    best = stars.groupBy("b").agg(F.max(F.struct("matched", "a")).alias("best")).select("best.a", "b")
    labels = connected(verified(best, sets, settings))
    still = labelled(labelled(stars.select("a", "b"), "a", labels, "ra"), "b", labels, "rb").where(F.col("ra") != F.col("rb")).select("a", "b")
    more = cut(verified(still.join(best, ["a", "b"], "left_anti"), sets, settings))
    labels = extended(labels, more)
    open_nodes = cut(nodes_to_verify(members, labels, classes, settings))
    if not open_nodes.isEmpty():
        also = open_nodes.join(nodes, "node", "left_anti")
        sets = sets.unionByName(stored(shingle_sets(docs, classes.join(also, "node"), settings, key, text), "sets"))
        labels = extended(labels, cut(block_links(members.join(open_nodes, "node"), labels, classes, sets, settings)))
    rooted = labelled(classes.select("node", "h1", "h2", "first"), "node", labels, "root")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    rooted = rooted.join(least, "root").select("h1", "h2", F.lit(True).alias("found"), "component_id")
    out = sketched.select("key", "n_shingles", "h1", "h2").join(rooted, ["h1", "h2"], "left")
    own = F.when(F.col("found") & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("key"))
    return out.select("key", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text", row_of: Column | None = None) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``; all rows with empty sets stay.

    Groups are decided by row, so null and repeated ids lose no text. The row with the least id stays, null ids last; of rows
    of a group that share it, the first by hash. ``row_of`` has to name rows; without it they are written once with a name.
    """
    row, place = free_name(docs, "row_"), free_name(docs, "place_")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows") if row_of is None else docs.withColumn(row, row_of)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(*columns).alias("hash"), F.col(row).alias("row"))
    found = components(rows.withColumn(place, order), settings, place, text)
    stay = found.where(F.col("kept")).select(F.col("key.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*columns)


def components_sql(settings: Settings) -> str:
    """DuckDB's form over documents without repeated ids: exact sets, all pairs that share a shingle, reachability."""
    k, percent = settings.shingle, settings.percent
    joined = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {joined})) END AS s FROM words
), sizes AS (
  SELECT doc_id, len(s) AS n FROM sets
), shingles AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= {percent} * (p.n + q.n - shared)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
