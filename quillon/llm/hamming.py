"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the sign pattern of a vector, cut into ``m`` segments of at most 16 bits. If two codes differ in at most
``m * a + j`` bits, one of the first ``j + 1`` segments differs in at most ``a`` bits, or one of the others in at most
``a - 1``. So a search that has looked up all values of the first ``j + 1`` segments within radius ``a`` and of the others
within ``a - 1`` has seen every code within distance ``m * a + j``. Radii grow, segment by segment, until the distance of the
kth verified code is covered. A pair of codes is met once, in the first segment of its least segment distance, which can be
told from the two codes alone.

Codes are dealt by hash into shards, queries into blocks; a task holds one shard's segment tables and searches them for one
block, many queries at a time. Of a large table, a sample is searched first: its kth distances bound the radii of all other
shards. A task emits at most k + 1 rows for each query. The stated query set meets all rows in blocks; both sides of a block
are bounded by parameters, and no pairs leave a task. (A join on (segment, value) over all codes instead makes rows that grow
with the square of the table, because a segment of 16 bits has the same number of values at every size.)

Equal codes are one entry with its k + 1 smallest ids, and equal queries are searched once, so copies of one vector cost
nothing more. Ties at the kth distance go to smaller ids. A row doesn't find itself; rows of one id are one row, with the
least of their codes. Ids are integers or texts that stand for integers; other texts count as null. Null vectors and null ids
are neither queries nor answers. Vectors of other lengths than ``bits`` are padded or cut. Fewer than k other rows give fewer
answers; an empty table gives an empty result. Extra columns aren't carried, so their names can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored

#: Most bits of a segment.
WIDTH = 16
#: Codes of a shard, at most and at least, and queries of a block.
SHARD, LEAST_SHARD, BLOCK = 65_536, 2_048, 16_384
#: Queries that are searched together, and codes of the sample that gives first bounds.
TOGETHER, SAMPLE = 128, 131_072


def segment_widths(bits: int) -> list[int]:
    """Bits of each segment, dealt out evenly."""
    m = -(-bits // WIDTH)
    return [bits // m + (n < bits % m) for n in range(m)]


def sign_code(vector: Column, widths: list[int]) -> Column:
    """The sign bits of a vector as an array of integers, one for each segment; bit n of a segment is set if its value n is above 0."""
    segments, at = [], 0
    for width in widths:
        parts = [F.when(F.get(vector, F.lit(at + n)) > 0, F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")) for n in range(width)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        segments.append(total)
        at += width
    return F.array(*segments)


def flips(width: int, radius: int) -> np.ndarray:
    """All masks of a segment with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


class Shard:
    """The segment tables of one shard of codes, given as one integer for each segment."""

    def __init__(self, codes: np.ndarray, widths: list[int]):
        self.codes, self.widths = codes.astype(np.uint64), widths
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(len(widths))]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=1 << w))]) for s, w in enumerate(widths)]

    def look_up(self, asked: np.ndarray, segment: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) of the pairs whose least segment distance is ``radius``, first in ``segment``."""
        values = asked[:, segment, None].astype(np.int64) ^ flips(self.widths[segment], radius)[None]
        first = self.starts[segment][values]
        count = self.starts[segment][values + 1] - first
        first, many = first.ravel(), count.ravel()
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        who, code = np.repeat(np.arange(len(asked)), count.sum(axis=1)), self.order[segment][at]
        far = np.bitwise_count(self.codes[code] ^ asked[who]).astype(np.int64)
        new = (far[:, :segment] > radius).all(axis=1) & (far[:, segment:] >= radius).all(axis=1)
        return who[new], code[new], far[new].sum(axis=1)

    def search(self, asked: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) of each query's k nearest codes that are no further than its bound, with all ties of the kth."""
        asked, m = asked.astype(np.uint64), len(self.widths)
        active, limit = np.arange(len(asked)), bounds.astype(np.int64).copy()
        found = [np.zeros(0, np.int64)] * 3
        for radius in range(max(self.widths) + 1):
            for segment in range(m):
                if radius <= self.widths[segment] and len(active):
                    who, code, far = self.look_up(asked[active], segment, radius)
                    who = active[who]
                    keep = far <= limit[who]
                    who, code, far = (np.concatenate([x, y[keep]]) for x, y in zip(found, (who, code, far), strict=True))
                    order = np.lexsort((far, who))
                    who, code, far = who[order], code[order], far[order]
                    # the kth of each query that has k bounds what is still worth finding
                    begin = np.searchsorted(who, np.arange(len(asked)))
                    has = np.flatnonzero(np.bincount(who, minlength=len(asked)) >= k)
                    limit[has] = far[begin[has] + k - 1]
                    keep = far <= limit[who]
                    found = [who[keep], code[keep], far[keep]]
                # ties of the kth distance lie within it, so covering it covers them too
                active = active[limit[active] > m * radius + segment]
            if not len(active):
                break
        return tuple(found)


def distinct_codes(rows: DataFrame, k: int) -> DataFrame:
    """``code, ids`` with the k + 1 smallest ids of each code. Spark limits each map task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def best(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of each ``key`` with the least (distance, id), with their rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def searched(asks: DataFrame, codes: DataFrame, widths: list[int], k: int) -> DataFrame:
    """``asked, distance, id`` of the k least in each shard of codes, for queries (``asked, bound``) in blocks."""
    n, q, cores = codes.count(), asks.count(), codes.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD), min(n // LEAST_SHARD, 2 * cores))
    blocks = max(1, -(-q // BLOCK))
    each = codes.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    to = asks.withColumn("block", F.pmod(F.xxhash64("asked"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(keys, codes: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(codes) and len(asks):
            shard, ids = Shard(np.array(codes.code.tolist(), np.int64), widths), codes.ids.tolist()
            for at in range(0, len(asks), TOGETHER):
                part = asks.iloc[at : at + TOGETHER]
                hits: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
                for who, code, far in zip(*(x.tolist() for x in shard.search(np.array(part.asked.tolist(), np.int64), k, part.bound.to_numpy())), strict=True):
                    hits[who] += [(far, int(x)) for x in ids[code]]
                out += [(asked, d, x) for asked, own in zip(part.asked, hits, strict=True) for d, x in sorted(own)[:k]]
        return pd.DataFrame(out, columns=["asked", "distance", "id"])

    # dealt explicitly: blocks are few bytes but much work, so Spark would put them together by their size
    many = min(shards * blocks, 2000)
    left, right = each.repartition(many, "shard", "block"), to.repartition(many, "shard", "block")
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "asked array<bigint>, distance int, id bigint")


def top_k(rows: DataFrame, queries: Column, k: int = 10, bits: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, rank, id, distance``: for each row that ``queries`` selects, the k nearest other rows."""
    widths = segment_widths(bits)
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.expr(f"try_cast(`{key}` AS BIGINT)").alias("id"), sign_code(F.col(vector), widths).alias("code"), queries.alias("asks")).where(F.col("id").isNotNull())
    rows = stored(rows.groupBy("id").agg(F.min("code").alias("code"), F.max("asks").alias("asks")), "codes")
    # the query itself is found too, so one more is searched for
    codes = stored(distinct_codes(rows.select("id", "code"), k), "distinct-codes")
    asks = stored(rows.where("asks").select(F.col("id").alias("query"), F.col("code").alias("asked")), "asks")
    wanted = asks.select("asked").distinct().withColumn("bound", F.lit(bits))
    n = codes.count()
    if n > 2 * SAMPLE:
        sample = codes.where(F.pmod(F.xxhash64(F.lit(1), "code"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))
        first = best(searched(wanted, sample, widths, k + 1), "asked", k + 1)
        bounds = first.groupBy("asked").agg(F.when(F.count(F.lit(1)) > k, F.max("distance")).alias("near"))
        wanted = stored(wanted.join(bounds, "asked", "left").select("asked", F.coalesce("near", "bound").alias("bound")), "asks")
    found = best(searched(wanted, codes, widths, k + 1), "asked", k + 1).drop("rank")
    mine = asks.join(found, "asked").where(F.col("id") != F.col("query"))
    return best(mine, "query", k).select("query", "rank", "id", "distance")


#: DuckDB's form over embeddings of 64 values: every row whose id is divisible by 100 against all rows.
TOP_K_SQL = """
WITH codes AS (
  SELECT vec_id AS id, list_reduce([CASE WHEN embedding[n + 1] > 0 THEN 1::UBIGINT << n ELSE 0::UBIGINT END FOR n IN range(64)], lambda a, b: a | b) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.id AS query, d.id, CAST(bit_count(xor(q.code, d.code)::BIT) AS INTEGER) AS distance
  FROM codes q JOIN codes d ON q.id % 100 = 0 AND q.id <> d.id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, id) AS INTEGER) AS rank FROM pairs
)
SELECT query AS query_id, rank, id AS vec_id, distance FROM ranked WHERE rank <= 10
"""
