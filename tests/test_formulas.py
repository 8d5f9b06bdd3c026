"""Formulas against a scanner that goes letter by letter, and names against a loop."""

import random

from pyspark.sql import functions as F

from quillon.operators import formulas as X


def scan(formula):
    """Tokens by hand: (kind, text)."""
    out, i, n = [], 0, len(formula)
    letter = lambda c: c.isascii() and (c.isalpha() or c == "_")
    while i < n:
        c = formula[i]
        if c in "\"'":
            j = i + 1
            while j < n and (formula[j] != c or formula[j + 1 : j + 2] == c):
                j += 2 if formula[j] == c else 1
            if j < n and c == '"':
                out.append(("string", formula[i : j + 1]))
                i = j + 1
                continue
            if j < n and formula[j + 1 : j + 2] == "!":
                out.append(("quoted", formula[i : j + 2]))
                i = j + 2
                continue
            out.append(("other", c))
            i += 1
            continue
        if letter(c) or c == "$":
            j = i
            while j < n and formula[j].isascii() and (formula[j].isalnum() or formula[j] in "_.$"):
                j += 1
            word = formula[i:j]
            if formula[j : j + 1] == "!" and letter(c) and "$" not in word:
                out.append(("bare", word + "!"))
                i = j + 1
                continue
            k = i + (c == "$")
            column = k
            while k < n and "A" <= formula[k] <= "Z" and k - column < 3:
                k += 1
            dollar = k < n and formula[k] == "$"
            d = k + dollar
            while d < n and formula[d] in "0123456789":
                d += 1
            if k > column and d > k + dollar and d == j and formula[j : j + 1] not in ("(", "!"):
                out.append(("absolute" if dollar else "cell", word))
            else:
                out.append(("word", word))
            i = j
            continue
        out.append(("other", c))
        i += 1
    return out


def by_hand(formula, rows, names):
    moved = renamed = ""
    for kind, text in scan(formula):
        if kind == "cell" and rows:
            digits = len(text.rstrip("0123456789"))
            moved += f"{text[:digits]}{max(1, int(text[digits:]) + rows)}"
        else:
            moved += text
        old = text[1:-2].replace("''", "'") if kind == "quoted" else text[:-1] if kind == "bare" else None
        new = names.get(old)
        plain = new is not None and kind == "bare" and all(c.isascii() and (c.isalnum() or c in "_.") for c in new) and not new[0].isdigit()
        renamed += text if new is None or new == old else f"{new}!" if plain else "'" + new.replace("'", "''") + "'!"
    return moved, renamed


def test_generated_formulas(spark):
    rng = random.Random(2)
    pieces = ["A1", "$B$2", "C$10", "$D7", "AB12:AC$40", "SUM(", ")", "+", "*2", '"A1 Sheet1!B2"', '"say ""A1"" "', "Sheet1!A1", "'My Sheet'!B2", "'It''s'!C3", "LOG10(", "x_1", "A1B", "Data.2!A9", ",", " ", "=", "é", "R1C1", "TRUE", "1E5", "'", "&", "$", "XFD1048576", "ABCD1"]
    formulas = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(800)]
    formulas = [f for f in formulas if "".join(t for _, t in scan(f)) == f]
    names = {"Sheet1": "Sheet1 (2)", "My Sheet": "Other", "It's": "It's (2)", "Data.2": "Data_3", "Same": "Same"}
    rows = [(n, f, rng.choice([-5, 0, 1, 30])) for n, f in enumerate(formulas)] + [(-1, None, 3)]
    mapped = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    got = {r["n"]: (r["m"], r["r"], r["t"]) for r in spark.createDataFrame(rows, "n INT, f STRING, by INT").select("n", X.moved(F.col("f"), F.col("by")).alias("m"), X.renamed(F.col("f"), mapped).alias("r"), F.array_join(X.tokens(F.col("f")), "").alias("t")).collect()}
    for n, f, by in rows:
        assert got[n] == ((*by_hand(f, by, names), f) if f is not None else (None, None, None)), f


def test_unique_names(spark):
    rng = random.Random(3)
    pool = ["A", "a", "A (2)", "B/C", "  x   y ", "", None, "n" * 40, "n" * 31, "N" * 29 + "zz", "[q]", "Sheet1", "sheet1 (2)"]
    rows = [(n, [rng.choice(pool) for _ in range(rng.randint(0, 9))], [x for x in rng.sample(["A", "Sheet1", "n" * 31, "x y", "Trang tính"], 3)]) for n in range(120)]
    got = {r["n"]: r["u"] for r in spark.createDataFrame(rows, "n INT, s ARRAY<STRING>, t ARRAY<STRING>").select("n", X.unique_names(F.col("s"), F.col("t")).alias("u")).collect()}
    for n, names, taken in rows:
        used, want = {t.lower() for t in taken}, []
        for name in names:
            base = " ".join("".join(" " if c in "\\/?*[]:" else c for c in name or "").split())[:31].strip() or "Trang tính"
            new, k = base, 1
            while new.lower() in used:
                k += 1
                new = base[: 31 - len(f" ({k})")].rstrip() + f" ({k})"
            used.add(new.lower())
            want.append(new)
        assert got[n] == want and all(len(x) <= 31 for x in want)
