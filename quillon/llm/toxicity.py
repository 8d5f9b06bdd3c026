"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns a text into symbols: insult, threat, target, negation, report, quotation mark, clause end. Small
transducers for negation, reported speech and targets are composed with it. Negation, report and targets on the left are one
machine that runs forwards; targets on the right are found by the same target transducer running backwards, so that the pair
is a bimachine. It emits matched clauses (an insult or a threat; asserted, negated or reported; aimed at somebody or not),
not isolated words; a clause carries the weight of its word, more if it is aimed.

All lexical classes are learned from labelled rows beside their seeds, by log-likelihood ratios whose bound grows with the
number of candidates: insults are words and word beginnings that tell the label by themselves; threats are words that tell it
where a target follows; negations and targets are words that lower or raise the share of label 1 in front of an insult, both
against the rows that have the same word elsewhere. A logistic model over the clause weights gives the score. Its weights can't be negative, and an asserted or aimed
clause never weighs less than the same clause negated, reported or aimed at nobody. What labels say little about follows the
insults: a seed word without labels weighs as much as the median of the learned seeds, and an asserted threat that is aimed at somebody starts out as an
asserted, aimed insult does. Scope words must stand in front of insults more often than among clean rows, which keeps out
function words.

The model is fitted on a bounded sample of labelled rows (``max_rows``); scoring sees every whole text. Labels, language,
source and ids are never inputs of a score.

Null and empty texts match nothing and get the score of a text without clauses. Very long texts are read whole, in two
passes over their matched words. Repeated rows score each by itself; of repeated keys in the labels the largest label counts.
Without usable labels the seed weights alone count. An empty table gives an empty result. Extra columns pass through. Rows
with a null key are scored, never learned from; null labels aren't either.
"""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quillon.llm.common import cut, small_batches, stored

#: Seed words by symbol, in English, German, French and Spanish. Words that are common in another of the
#: languages (the German article among the threats) can't stand here, because the language of a text isn't known.
SEEDS = {
    "I": """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumb filth vermin
        dummkopf trottel abschaum versager idiotin connard imbécile ordure minable crétin estúpido imbécil escoria basura idiota""",
    "T": "kill murder hurt destroy stab shoot strangle töten umbringen tuer frapper détruire matar destruir",
    "Y": """you your yours yourself he him she her they them their these those people everyone du dich dein ihr euch sie er
        tu toi vous votre ton il elle ils elles usted tú te ustedes él ella ellos""",
    "N": "not never no none nobody isn't aren't wasn't don't nicht kein keine niemals pas jamais aucun nunca ningún jamás",
    "R": """said says say called calls claimed wrote quoted reported alleged sagte nannte schrieb behauptete dit disait appelé
        écrit dijo llamó escribió""",
}
SEED_WEIGHT = 2.0
#: Factor of a clause that is aimed at somebody.
AIMED = 1.5
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;\n\"“”«»]")
ENDS, QUOTES = frozenset(".!?;\n"), frozenset("\"“”«»")
#: Letters of the word beginnings that are learned beside whole words.
BEGINNINGS = (4, 5, 6)
#: Words that a scope reaches over; longer gaps end every scope.
REACH = 4
#: Least share of label 1 among the documents of a learned insult or threat.
TELLING = 0.7
#: How much more often a learned target or negation stands in front of insults than in clean rows.
LIFT = 2.0


class Transducer:
    """A deterministic transducer: ``arcs[state, symbol] = (next state, emitted symbol, weight)``; symbols without an arc pass unchanged."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]]):
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


#: Clause symbols: I and T with n (negated), r (reported) and a (aimed) behind them.
KINDS = [k + n + r + a for k, n, r, a in product("IT", ("", "n"), ("", "r"), ("", "a"))]
KIND_AT = {k: n for n, k in enumerate(KINDS)}
SYMBOLS = "ITYNRQBo"


def negation() -> Transducer:
    """A negation word scopes over the next REACH words of its clause."""
    arcs = {}
    for s in range(REACH + 1):
        arcs[s, "N"] = (REACH, "N", 1.0)
        arcs[s, "B"] = (0, "B", 1.0)
        for other in "oYRQ":
            arcs[s, other] = (max(0, s - 1), other, 1.0)
        for k in "IT":
            arcs[s, k] = (max(0, s - 1), k + "n" if s else k, 1.0)
    return Transducer(arcs)


def reported() -> Transducer:
    """A verb of saying scopes to the end of its clause, an opening quotation mark to the closing one (or the end of the clause)."""
    arcs = {}
    for s in range(3):
        arcs[s, "R"] = (max(s, 1), "R", 1.0)
        arcs[s, "Q"] = (0 if s == 2 else 2, "Q", 1.0)
        arcs[s, "B"] = (0, "B", 1.0)
        for k in ("I", "T", "In", "Tn"):
            arcs[s, k] = (s, k + "r" if s else k, 1.0)
    return Transducer(arcs)


def aimed() -> Transducer:
    """Somebody named within REACH words before an insult or threat is its target; run backwards, within REACH words behind it."""
    arcs = {}
    for s in range(REACH + 1):
        arcs[s, "Y"] = (REACH, "Y", 1.0)
        arcs[s, "B"] = (0, "B", 1.0)
        for other in "oNRQ":
            arcs[s, other] = (max(0, s - 1), other, 1.0)
        for k in (x for x in KINDS if "a" not in x):
            arcs[s, k] = (max(0, s - 1), k + "a" if s else k, AIMED if s else 1.0)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer, states: tuple[int, int], symbols: str) -> Transducer:
    """What ``first`` emits goes into ``second``; a state of the composition is the pair of states, numbered, weights multiply."""
    arcs = {}
    for a, b in product(range(states[0]), range(states[1])):
        for symbol in symbols:
            a2, middle, w1 = first.step(a, symbol)
            b2, out, w2 = second.step(b, middle)
            arcs[a * states[1] + b, symbol] = (a2 * states[1] + b2, out, w1 * w2)
    return Transducer(arcs)


def table_of(machine: Transducer, states: int) -> dict[str, list[tuple[int, str, float]]]:
    """A machine as a list of arcs for each symbol, by state."""
    return {symbol: [machine.step(s, symbol) for s in range(states)] for symbol in SYMBOLS}


def forwards() -> dict[str, list[tuple[int, str, float]]]:
    n = REACH + 1
    return table_of(compose(compose(negation(), reported(), (n, 3), SYMBOLS), aimed(), (3 * n, n), SYMBOLS), 3 * n * n)


class Grammar:
    """The lexicon and the machines; small, made on the driver and shipped to the executors. ``learned`` has weights of insults and threats by word, ``scopes`` the symbols of further targets and negations."""

    def __init__(self, learned: dict[str, dict[str, float]] | None = None, beginnings: dict[str, float] | None = None, scopes: dict[str, str] | None = None):
        self.words = {w: (k, SEED_WEIGHT if k in "IT" else 0.0) for k, ws in SEEDS.items() for w in ws.split()}
        for symbol, words in (learned or {}).items():
            self.words |= {w: (symbol, x) for w, x in words.items() if self.words.get(w, symbol)[0] in "IT"}
        self.words |= {w: (symbol, 0.0) for w, symbol in (scopes or {}).items() if w not in self.words}
        self.words |= dict.fromkeys(ENDS, ("B", 0.0)) | dict.fromkeys(QUOTES, ("Q", 0.0))
        self.beginnings = beginnings or {}
        # seed words that labels say nothing about weigh as much as the median of those that they tell about
        insults = (learned or {}).get("I", {})
        if told := [insults[w] for w in SEEDS["I"].split() if w in insults]:
            self.words |= {w: (k, float(np.median(told))) for k in "IT" for w in SEEDS[k].split() if w not in (learned or {}).get(k, {})}
        self.heads = {w[: BEGINNINGS[0]] for w in self.beginnings}
        self.ahead, self.back = forwards(), table_of(aimed(), REACH + 1)

    def symbols(self, text: str) -> list[tuple[int, tuple[str, float]]]:
        """Places, symbols and weights of the words that the lexicon knows."""
        tokens = TOKEN.findall(text.lower())
        words, heads, head = self.words, self.heads, BEGINNINGS[0]
        found = [(n, words.get(t) or self.longest(t)) for n, t in enumerate(tokens) if t in words or t[:head] in heads]
        return [hit for hit in found if hit[1]]

    def longest(self, token: str) -> tuple[str, float] | None:
        """The longest learned beginning of a word, if there is one."""
        return next((("I", self.beginnings[token[:k]]) for k in reversed(BEGINNINGS) if token[:k] in self.beginnings), None)

    @staticmethod
    def run(arcs: dict[str, list[tuple[int, str, float]]], hits: list[tuple[int, tuple[str, float]]], backwards: bool = False) -> list[tuple[str, float]]:
        """What a machine emits at each hit; words between hits are plain ones."""
        state, before, out = 0, None, []
        for n, (symbol, _) in reversed(hits) if backwards else hits:
            for _ in range(0 if before is None else min(abs(n - before) - 1, REACH)):
                state = arcs["o"][state][0]
            state, emitted, factor = arcs[symbol][state]
            out.append((emitted, factor))
            before = n
        return out[::-1] if backwards else out

    def clauses(self, text: str) -> np.ndarray:
        """Summed weights of the matched clauses, by kind."""
        found = np.zeros(len(KINDS))
        hits = self.symbols(text)
        if not any(k in "IT" for _, (k, _) in hits):
            return found
        for (_, (symbol, weight)), (left, factor), (right, behind) in zip(hits, self.run(self.ahead, hits), self.run(self.back, hits, True), strict=True):
            if symbol in "IT":
                kind = left + "a" if right[-1] == "a" and left[-1] != "a" else left
                found[KIND_AT[kind]] += weight * max(factor, behind)
        return found


#: For each feature, the clause kinds that it sums: all of a letter, the asserted, the aimed, the asserted and aimed ones.
PARTS = [[k[0] == letter and (not plain or not set(k) & set("nr")) and (not at or k[-1] == "a") for k in KINDS] for letter in "IT" for plain, at in product((False, True), (False, True))]


def features(sums: np.ndarray) -> np.ndarray:
    """Of clause weights by kind: logarithms of the sums over PARTS, whether an insult or an aimed threat is asserted, and 1. As the parts lie inside each other, weights that aren't negative order the kinds."""
    parts = sums @ np.array(PARTS, float).T
    asserted = (parts[:, [2, 7]].sum(axis=1, keepdims=True) > 0).astype(float)
    return np.concatenate([np.log1p(parts), asserted, np.ones((len(sums), 1))], axis=1)


def start_coefficients() -> np.ndarray:
    """Coefficients before any label is seen, in the order of ``features``: asserted clauses count most, threats need a target."""
    return np.array([0.2, 0.2, 0.8, 0.2, 0.1, 0.3, 0.2, 0.8, 1.5, -3.0])


def like_insults(w: np.ndarray) -> np.ndarray:
    """Where coefficients start from once insults have been fitted: an asserted, aimed threat counts like an asserted, aimed insult."""
    out = start_coefficients()
    out[7] = max(0.0, w[:4].sum() - out[4:7].sum())
    return out


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients from the labels; those of threats first start from what insults have shown."""
    return logistic(x, y, centre=like_insults(logistic(x, y)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 0.1, centre: np.ndarray | None = None) -> np.ndarray:
    """Newton's method, projected on coefficients of 0 and more (but for the last, the intercept), with a ridge towards ``centre``."""
    centre = start_coefficients() if centre is None else centre
    least = np.append(np.zeros(len(centre) - 1), -np.inf)
    w = centre.copy()

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * ((v - centre) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * (w - centre)
        free = (w > least) | (slope < 0)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        move, then = 1.0, math.inf
        while move > 1e-6 and (then := loss(np.maximum(least, w - move * step))) > now:
            move /= 2
        if now - then < 1e-8:
            break
        w, now = np.maximum(least, w - move * step), then
    return w


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _log_odds(bad: int, n: int, share: float) -> float:
    return min(6.0, math.log((bad + 0.5) / (n - bad + 0.5)) - math.log(share / (1 - share)))


def telling(sample: DataFrame, terms: Column) -> dict[str, float]:
    """Terms of ``toxic`` rows whose share of label 1 is far above the rows', by their log-odds against it. Documents are counted, not places."""
    totals = sample.agg(F.count(F.lit(1)).alias("all"), F.sum("toxic").alias("bad")).first()
    if not totals["all"] or not totals["bad"] or totals["bad"] == totals["all"]:
        return {}
    share = totals["bad"] / totals["all"]
    counts = sample.select(F.explode(F.array_distinct(terms)).alias("term"), "toxic").groupBy("term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    counts = cut(counts.where(F.col("n") >= 3))
    bound = 2 * math.log(max(2, counts.count())) + 4
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("bad"), share) + part(F.col("n") - F.col("bad"), 1 - share))
    good = counts.where((F.col("bad") >= F.greatest(F.lit(TELLING), F.lit(share)) * F.col("n")) & (ratio > bound))
    return {r["term"]: _log_odds(r["bad"], r["n"], share) for r in good.collect()}


def telling_there(sample: DataFrame, there: Column) -> tuple[dict[str, float], dict[str, float]]:
    """Words that stand in ``there`` of far more (or less) toxic rows than those that have the same word elsewhere alone: log-odds of the first and of the second kind.

    The comparison is within the rows of a word, so that what goes with the word in any place, such as its language, cancels out.
    """
    inside = F.array_distinct(there)
    both = F.concat(F.transform(inside, lambda w: F.struct(w.alias("term"), F.lit(1).alias("here"))), F.transform(F.array_except("words", inside), lambda w: F.struct(w.alias("term"), F.lit(0).alias("here"))))
    each = sample.select(F.explode(both).alias("t"), "toxic").select("t.*", "toxic")
    here = F.col("here")
    counts = each.groupBy("term").agg(F.sum(here).alias("n"), F.sum(here * F.col("toxic")).alias("bad"), F.sum(1 - here).alias("n0"), F.sum((1 - here) * F.col("toxic")).alias("bad0"))
    counts = cut(counts.where((F.col("n") >= 3) & (F.col("n0") >= 3)))
    bound = 2 * math.log(max(2, counts.count())) + 4
    part = lambda k, n: F.when((k > 0) & (k < n), k * F.log(k / n) + (n - k) * F.log((n - k) / n)).otherwise(0.0)
    n, bad, n0, bad0 = (F.col(c) for c in ("n", "bad", "n0", "bad0"))
    ratio = 2 * (part(bad, n) + part(bad0, n0) - part(bad + bad0, n + n0))
    rows = counts.where(ratio > bound).collect()
    odds = {r["term"]: (_log_odds(r["bad"], r["n"], (r["bad0"] + 0.5) / (r["n0"] + 1)), r["bad"] / r["n"]) for r in rows}
    return {w: x for w, (x, share) in odds.items() if x > 0 and share >= TELLING}, {w: x for w, (x, _) in odds.items() if x < 0}


def _before(place: Column) -> Column:
    """Places of ``words`` for which ``place`` holds, as the words that stand within REACH in front of them."""
    return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda n: place(F.get("words", n))), lambda n: F.slice("words", F.greatest(F.lit(1), n - REACH + 1), F.least(n, F.lit(REACH)))))


def scopes_of(sample: DataFrame, found: dict[str, float], there: Column) -> list[str]:
    """The words that make up LIFT times as much of the places ``there`` as of the words of clean rows."""
    if not found:
        return []
    named = lambda words: F.filter(words, lambda w: w.isin(sorted(found)))
    clean = F.when(F.col("toxic") == 0, F.col("words")).otherwise(F.array().cast("array<string>"))
    each = sample.select(there.alias("there"), clean.alias("clean"))
    all_ = each.agg(F.sum(F.size("there")).alias("there"), F.sum(F.size("clean")).alias("clean")).first()
    marked = F.concat(F.transform(named(F.col("there")), lambda w: F.struct(w.alias("term"), F.lit(1).alias("there"))), F.transform(named(F.col("clean")), lambda w: F.struct(w.alias("term"), F.lit(0).alias("there"))))
    counts = each.select(F.explode(marked).alias("t")).select("t.*").groupBy("term").agg(F.sum("there").alias("n"), F.sum(1 - F.col("there")).alias("n0"))
    return [r["term"] for r in counts.collect() if r["n"] * max(1, all_["clean"]) >= LIFT * max(1, r["n0"]) * all_["there"]]


def learn(sample: DataFrame) -> tuple[dict[str, dict[str, float]], dict[str, float], dict[str, str]]:
    """Insults and threats, beginnings of insults, targets and negations from ``text, toxic`` rows."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    sample = cut(sample.select(words.alias("words"), F.col("toxic").cast("int").alias("toxic")).where(F.size("words") > 0))
    seeds = {k: ws.split() for k, ws in SEEDS.items()}
    known = {w for ws in seeds.values() for w in ws}
    insults = telling(sample, F.col("words"))
    long_enough = F.filter("words", lambda w: F.length(w) > max(BEGINNINGS))
    starts = telling(sample, F.flatten(F.transform(long_enough, lambda w: F.array(*[F.substring(w, 1, k) for k in BEGINNINGS]))))
    begins = lambda w: any(w[:k] in starts for k in BEGINNINGS)
    # threats: telling where a target follows, but not elsewhere
    aimed_at, _ = telling_there(sample, _before(lambda w: w.isin(seeds["Y"])))
    threats = {w: x for w, x in aimed_at.items() if w not in insults and w not in known and not begins(w)}
    # scopes: what stands in front of an insult changes what the insult says
    # (whole words alone: beginnings are weaker evidence, so places beside them differ by language)
    is_insult = lambda w: w.isin(sorted({*insults, *seeds["I"]}))
    more, less = telling_there(sample.where(F.exists("words", is_insult)), _before(is_insult))
    more, less = (scopes_of(sample, found, _before(is_insult)) for found in (more, less))
    fresh = lambda found: [w for w in found if w not in known and w not in insults and w not in threats and not begins(w)]
    return {"I": insults, "T": threats}, starts, dict.fromkeys(fresh(less), "N") | dict.fromkeys(fresh(more), "Y")


class Model:
    """The fitted operator: ``score`` gives the probability of label 1 as a column."""

    def __init__(self, grammar: Grammar, coefficients: np.ndarray):
        self.grammar, self.coefficients = grammar, coefficients

    def score(self, text: Column) -> Column:
        grammar, w = self.grammar, self.coefficients

        @pandas_udf("double")
        def probability(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype=float)
            sums = np.stack([grammar.clauses(x) for x in column])
            return pd.Series(1 / (1 + np.exp(-np.clip(features(sums) @ w, -30, 30))))

        return probability(F.coalesce(text.cast("string"), F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 20_000) -> Model:
    """Learn from labelled rows that aren't held out, at most about ``max_rows`` of them, chosen by hash."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    rows = usable.count()
    if rows > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * max_rows / rows))
    picked = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # the picked labels are at most about max_rows rows of 12 bytes: the bound that lets them be broadcast
    sample = stored(picked.join(F.broadcast(usable), "key").drop("key"), "toxic-sample")
    grammar = Grammar(*learn(sample))

    @pandas_udf("array<double>")
    def clause_sums(column: pd.Series) -> pd.Series:
        return column.map(grammar.clauses)

    got = sample.select(clause_sums("text").alias("sums"), "toxic").collect()  # about max_rows rows at most
    if not got:
        return Model(grammar, start_coefficients())
    x = features(np.array([r["sums"] for r in got], dtype=float))
    return Model(grammar, fitted(x, np.array([float(r["toxic"]) for r in got])))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows that score below ``threshold``, with the columns of ``docs``."""
    model = fit(docs, labels, key, text)
    return docs.where(model.score(F.col(text)) < threshold)
