"""Quality rules by weak supervision, from DataFrame and SQL functions alone.

Rules vote for (1) or against (-1) a document, or abstain (0). Expectation-maximisation over the counts of vote patterns
estimates how often each rule is for good and for bad documents, and the share of good ones; the posterior probability that a
document is good replaces all-must-pass filtering. The counts cover every document. There are at most 3**rules patterns,
whatever the corpus; each EM round is an aggregate over them that brings three sums for each rule to the driver.

Repeated 8-word windows are found inside a row: hashes of all windows are sorted with their positions, equal neighbours
marked, and the words they cover counted, in n log n. No text leaves its row.

The rates are free: a weak Beta prior (``PRIOR`` pseudo-votes) stands behind each, and no bound.

Null and empty texts have no words: all counts 0, base_failed. Very long texts are handled whole. Repeated rows and ties
count each by itself. An empty table gives an empty result. Extra columns aren't carried by ``measure``; ``keep_good``
keeps exactly its input's columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, free_name, stored

WINDOW = 8
#: Votes for, votes against; a document that meets neither has the rule abstain. Shares are per word unless they say otherwise.
RULES = {
    "length": ("n_words >= 50", "n_words < 20"),
    "word_length": ("word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "runs": ("100 * n_runs <= n_words", "10 * n_runs > n_words"),
    "dup_lines": ("n_dup_lines = 0 AND n_lines >= 3", "2 * n_dup_lines > n_lines"),
    "repeats": ("50 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "capitals": ("100 * n_capitals <= 15 * word_chars", "100 * n_capitals > 40 * word_chars"),
    "variety": ("n_words >= 20 AND 10 * n_distinct >= 3 * n_words", "10 * n_distinct < n_words"),
    "shouting": ("n_shouts = 0", "10 * n_shouts > n_words"),
    "stops": ("50 * n_stops >= n_words AND 3 * n_stops <= n_words", "n_words >= 50 AND 500 * n_stops < n_words"),
    "letters": ("10 * n_lettered >= 9 * n_words", "10 * n_lettered < 7 * n_words"),
}
#: Start of the EM: the share of good documents, and how often a voting rule is for a good and for a bad one. Bad documents
#: mostly break a few rules and pass the others, so a vote against says much and one in favour little.
SHARE, RIGHT, WRONG, ROUNDS = 0.8, 0.995, 0.9, 100
#: Pseudo-votes behind each start value: a weak Beta prior, which decides only where rules hardly ever vote.
PRIOR = 20.0
#: The EM ends when no rate moves by more than this.
SETTLED = 1e-4


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once for the row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _covered() -> str:
    """Words in windows found twice or more, from the hashes ``h`` of all windows."""
    marked = "filter(s, (x, k) -> coalesce(get(s, k - 1).v = x.v, false) OR coalesce(get(s, k + 1).v = x.v, false))"
    places = f"array_sort(transform({marked}, x -> x.k))"
    fold = f"aggregate({places}, named_struct('e', 0, 'n', 0L), (a, p) -> named_struct('e', p + {WINDOW}, 'n', a.n + p + {WINDOW} - greatest(a.e, p)), a -> a.n)"
    ordered = _let("array_sort(transform(h, (v, k) -> named_struct('v', v, 'k', k)))", "s", fold)
    return f"if(size(array_distinct(h)) = size(h), 0L, {ordered})"


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the counts of each row's whole text."""
    hashes = f"if(size(w) >= {WINDOW}, transform(sequence(1, size(w) - {WINDOW - 1}), k -> xxhash64(slice(w, k, {WINDOW}))), cast(array() AS array<bigint>))"
    per_words = "named_struct('n_words', cast(size(w) AS bigint), 'n_distinct', cast(size(array_distinct(w)) AS bigint), 'n_lettered', cast(size(filter(w, x -> x rlike '\\\\p{L}')) AS bigint), 'n_repeat_words', " + _let(hashes, "h", _covered()) + ")"
    words = "filter(split(body, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"
    per_lines = "named_struct('n_lines', cast(size(l) AS bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint))"
    lines = "filter(split(body, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    body = F.col("body")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = rows.select(
        "key",
        F.expr(_let(words, "w", per_words)).alias("of_words"),
        F.expr(_let(lines, "l", per_lines)).alias("of_lines"),
        F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]{2,}")).cast("long").alias("n_runs"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(body, F.lit("!!")).cast("long").alias("n_shouts"),
        F.regexp_count(body, F.lit(r"[.?!](?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_stops"),
    )
    return found.select("key", "of_words.*", "of_lines.*", "word_chars", "n_symbols", "n_runs", "n_capitals", "n_shouts", "n_stops")


def votes() -> Column:
    """The votes of all rules, in their order, as array<int>."""
    return F.array(*[F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for good, bad in RULES.values()])


def _posterior(model: dict, vote: str) -> Column:
    """Probability of a good document by its votes. The log odds of all votes stand in one array literal, so that each EM round runs the same compiled plan."""
    odds = [x for right, wrong in model["rules"] for x in (math.log((1 - right) / (1 - wrong)), 0.0, math.log(right / wrong))]
    worth = F.array(*[F.lit(x) for x in [math.log(model["share"] / (1 - model["share"])), *odds]])
    places = F.transform(F.col(vote), lambda v, k: F.get(worth, 3 * k + v + 2))
    return 1 / (1 + F.exp(-F.aggregate(places, F.get(worth, F.lit(0)), lambda total, x: total + x)))


def rates(sums: dict[tuple[int, int], tuple[float, float]], rules: int) -> dict:
    """The M step from the posterior weights of good and bad documents by (rule, vote), under the Beta prior.

    A rule that would be for bad documents more often than for good ones tells nothing: its two rates are pooled, which is
    the likeliest choice under the condition that a vote in favour never counts against a document.
    """
    at = lambda k, v: sums.get((k, v), (0.0, 0.0))
    out = []
    for k in range(rules):
        (up, up_bad), (down, down_bad) = at(k, 1), at(k, -1)
        right = (up + PRIOR * RIGHT, up + down + PRIOR)
        wrong = (up_bad + PRIOR * WRONG, up_bad + down_bad + PRIOR)
        pooled = (right[0] + wrong[0]) / (right[1] + wrong[1])
        pair = (right[0] / right[1], wrong[0] / wrong[1])
        out.append(pair if pair[0] >= pair[1] else (pooled, pooled))
    good, bad = (sum(at(0, v)[c] for v in (-1, 0, 1)) for c in (0, 1))
    return {"share": (good + PRIOR * SHARE) / (good + bad + PRIOR), "rules": out}


def fit(measured: DataFrame) -> dict:
    """The share of good documents and, for each rule, how often it votes for good and for bad documents when it votes."""
    patterns = cut(measured.select(votes().alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
    model = {"share": SHARE, "rules": [(RIGHT, WRONG)] * len(RULES)}
    for _ in range(ROUNDS):
        weighed = patterns.select("votes", (F.col("n") * _posterior(model, "votes")).alias("good"), "n")
        each = weighed.select(F.posexplode("votes").alias("rule", "vote"), "good", (F.col("n") - F.col("good")).alias("bad"))
        sums = {(r["rule"], r["vote"]): (r["good"], r["bad"]) for r in each.groupBy("rule", "vote").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()}
        before, model = model, rates(sums, len(RULES))
        if max(abs(x - y) for m, n in zip(before["rules"], model["rules"], strict=True) for x, y in zip(m, n, strict=True)) < SETTLED:
            break
    return model


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The counts with ``base_failed``, ``p_good`` and ``kept``."""
    measured = stored(measure(docs, key, text), "quality")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    model = fit(measured)
    out = measured.withColumn("base_failed", failed).withColumn("votes", votes()).withColumn("p_good", _posterior(model, "votes"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, row: Column | None = None) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``. Each row goes by its own text, whatever its ``key``.

    With ``row``, which has to name rows, they are filtered by a join; without, they are written once with their counts.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if row is None:
        whole = docs.select(F.struct(*columns).alias("key"), F.col(text).alias("text"))
        return score(whole, "key", "text", threshold).where(F.col("kept")).select("key.*")
    name = free_name(docs, "row_")
    rows = docs.withColumn(name, row)
    kept = score(rows, name, text, threshold).where(F.col("kept")).select(F.col("key").alias(name))
    return rows.join(kept, name, "left_semi").select(*columns)
