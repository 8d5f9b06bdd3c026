"""Licence scans by a positional rare-token index, from DataFrame and SQL functions alone.

The index holds the words of whole licence templates with their places. Document frequencies of all template words are
counted over the whole corpus. A file's licence words are looked up from the highest IDF down, as far as they can decide: a
template's words of lowest IDF, up to ``TAIL`` of its weight, are never looked up, because without the others they can't
reach ``SHARE`` (the prefix filter of similarity joins, so nothing is lost). A word at place ``p`` of a file and at place ``t``
of a template votes for the alignment ``p - t``; the postings are intersected by summing the votes of each alignment. Those
that can still reach ``SHARE`` with the tail are compared with the template word by word, at the alignment: they stay if they
hold enough of the whole template's IDF weight and one of its mandatory key phrases stands where the alignment says. Base
phrases are matched at all places beside that.

The score is the largest share that a file holds of a template, and at least a half for a base phrase.

Templates, phrases and the index are parameters of this module: their size doesn't grow with the data. Votes are summed by
(row, template, alignment) after map-side combination, so that a file with very many hits isn't gathered anywhere.

Null and empty texts have no words and no label, score 0. Very long texts are scanned whole. Repeated rows are scanned
each by itself; ties between templates give all their labels. An empty table gives an empty result. Extra columns aren't
carried, so their names can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, UPPER, stored

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public licence notices and statements by label, with their mandatory key phrases (one of them has to stand in place).
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "is free software you can redistribute it and or modify"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["in the hope that it will be useful but without any warranty"]),
    ("gpl-3", "gnu general public license version 3", ["general public license version 3"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "you may not use this file except in compliance"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ["agreed to in writing software distributed under the license", "distributed on an as is basis"]),
    ("apache-2.0", "apache license version 2 0", ["license version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["deal in the software without restriction", "copy modify merge publish distribute sublicense"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "permitted provided that the following conditions are met"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain the above copyright"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce the above copyright"]),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", ["provided by the copyright holders and contributors"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license", "source code form is subject to the terms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software", "with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial", ["attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "creative commons attribution sharealike", ["attribution sharealike"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["public domain dedication"]),
]
#: Share of a template's IDF weight that an alignment has to hold: notices of more than LONG words are often quoted in part,
#: short statements have to stand nearly whole, so that a passing mention of a name isn't one.
LONG, SHARE_LONG, SHARE_SHORT = 13, 0.4, 0.8
#: Share of a template's weight in words of lowest IDF that aren't looked up. Less than SHARE, so every match has votes.
TAIL = 0.3
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A template with its index: the weight of each place, the looked-up places, and the places of its key phrases."""

    label: str
    words: list[str]
    weights: list[float]
    looked_up: list[int]
    spans: list[tuple[int, int]]

    @property
    def weight(self) -> float:
        return sum(self.weights)

    @property
    def share(self) -> float:
        return SHARE_LONG if len(self.words) > LONG else SHARE_SHORT

    @property
    def least_votes(self) -> float:
        """What votes have to hold before the words of the tail could make up for the rest."""
        return self.share * self.weight - sum(w for k, w in enumerate(self.weights) if k not in self.looked_up)


def template(label: str, text: str, keys: list[str], idf: dict[str, float]) -> Template:
    words = text.split()
    weights = [idf[w] for w in words]
    spans = [(k, k + len(p.split()) - 1) for p in keys for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    left, looked_up = TAIL * sum(weights), []
    for w in sorted(set(words), key=lambda w: (idf[w], w)):
        places = [k for k, x in enumerate(words) if x == w]
        left -= idf[w] * len(places)
        if left < 0:
            looked_up += places
    return Template(label, words, weights, sorted(looked_up), spans)


def split_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, in order."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, GAP), lambda x: x != "")


def _list(values: list[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _base(words: str) -> str:
    """Places of base phrases in ``words``: array of (place, label) in order of place."""
    cases = " ".join(f"WHEN {' AND '.join(f'coalesce(get({words}, k + {n}) = {chr(39)}{w}{chr(39)}, false)' for n, w in enumerate(p.split()))} THEN '{label}'" for p, label in BASE.items())
    heads = _list(sorted({p.split()[0] for p in BASE}))
    return f"filter(transform(filter(sequence(0, size({words})), k -> coalesce(get({words}, k) IN ({heads}), false)), k -> named_struct('place', k, 'label', CASE {cases} END)), x -> x.label IS NOT NULL)"


def index(docs: DataFrame, text: str = "text") -> list[Template]:
    """The templates with IDF weights from all documents. What comes to the driver is bounded by the templates' words."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    inside = F.array_distinct(F.filter(split_words(F.col(text)), lambda x: x.isin(vocabulary)))
    # one pass counts the words and, as the null word, the rows
    seen = docs.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), inside)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    known = {r["word"]: r["n"] for r in seen}
    rows = known.pop(None, 0)
    idf = {w: math.log(1 + (rows + 1) / (known.get(w, 0) + 1)) for w in vocabulary}
    return [template(label, t, keys, idf) for label, t, keys in TEMPLATES]


def _compared(templates: list[Template], words: Column, at: Column) -> Column:
    """Share of the template's weight that ``words`` hold at an alignment, where a key phrase stands in place; else null."""
    constant = lambda lists, kind: F.array(*[F.array(*[F.lit(x) for x in xs]).cast(kind) for xs in lists])
    number, start = at["template"], at["alignment"]
    own = F.get(constant([t.words for t in templates], "array<string>"), number)
    weights = F.get(constant([t.weights for t in templates], "array<double>"), number)
    firsts, lasts = (F.get(constant([[s[k] for s in t.spans] for t in templates], "array<int>"), number) for k in (0, 1))
    same = lambda k: F.get(words, start + k).eqNullSafe(F.get(own, k))
    held = F.aggregate(F.transform(weights, lambda w, k: F.when(same(k), w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    key = F.exists(F.zip_with(firsts, lasts, lambda a, b: F.forall(F.sequence(a, b), same)), lambda x: x)
    total = F.get(F.array(*[F.lit(t.weight) for t in templates]), number)
    return F.when(key, F.least(F.lit(1.0), held / total))


def aligned(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """``row, found``: for each row with a verified alignment, its (label, share) pairs. ``rows`` has ``row, hits, body``."""
    spark = rows.sparkSession
    places = [(w, n, k, t.weights[k]) for n, t in enumerate(templates) for k in t.looked_up for w in [t.words[k]]]
    lists = ", ".join(f"named_struct('word', '{w}', 'template', {n}, 'at', {k}, 'idf', {x!r}D)" for w, n, k, x in places)
    postings = F.broadcast(spark.sql(f"SELECT inline(array({lists}))"))  # bounded by the templates
    needed = F.array(*[F.lit(t.least_votes) for t in templates])
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    votes = hits.join(postings, "word").groupBy("row", "template", (F.col("place") - F.col("at")).alias("alignment")).agg(F.sum("idf").alias("held"))
    enough = votes.where(F.col("held") >= F.get(needed, F.col("template")) - 1e-9)
    open_rows = enough.groupBy("row").agg(F.collect_list(F.struct("template", "alignment")).alias("at"))
    bodies = rows.where(F.col("body").isNotNull()).select("row", "body").join(stored(open_rows, "alignments"), "row").select("row", "at", split_words(F.col("body")).alias("words"))
    least = F.array(*[F.lit(t.share) for t in templates])
    labels = F.array(*[F.lit(t.label) for t in templates])
    shares = F.transform("at", lambda x: F.struct(F.get(labels, x["template"]).alias("label"), _compared(templates, F.col("words"), x).alias("share"), F.get(least, x["template"]).alias("least")))
    found = F.filter(shares, lambda x: x["share"] >= x["least"] - 1e-9)
    return bodies.select("row", found.alias("found")).where(F.size("found") > 0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row."""
    templates = index(docs, text)
    rare = _list(sorted({t.words[k] for t in templates for k in t.looked_up}))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), split_words(F.col(text)).alias("words"))
    found = f"named_struct('n', size(w), 'base', {_base('w')}, 'hits', filter(transform(w, (x, k) -> if(x IN ({rare}), named_struct('word', x, 'place', k), null)), x -> x IS NOT NULL))"
    rows = rows.select("key", "body", F.expr(f"element_at(transform(array(words), w -> {found}), 1)").alias("f"))
    # only texts with looked-up words are written once more, for the comparison at their alignments
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "key", F.col("f.n").cast("long").alias("n_words"), F.col("f.base").alias("base"), F.col("f.hits").alias("hits"), F.when(F.size("f.hits") > 0, F.col("body")).alias("body"))
    rows = stored(rows, "licences")
    best = aligned(rows, templates).select("row", F.transform("found", lambda x: x["label"]).alias("more"), F.array_max(F.transform("found", lambda x: x["share"])).alias("share"))
    own = F.array_distinct(F.transform("base", lambda x: x["label"]))
    every = F.array_sort(F.array_distinct(F.concat(own, F.coalesce(F.col("more"), F.array().cast("array<string>")))))
    places = F.transform("base", lambda x: x["place"])
    certain = F.when(F.size(own) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return rows.join(best, "row", "left").select(
        "key", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.greatest(certain, F.coalesce("share", F.lit(0.0))).alias("score"),
    )
