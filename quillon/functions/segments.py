"""Cutting texts into sentences, speech chunks, captions and evidence chunks, inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.text import let as _let


def sentences(text: Column, ends: str = ".!?;:") -> Column:
    """Pieces between sentence ends and white space."""
    clean = T.squeeze(F.coalesce(text, F.lit("")))
    return F.filter(F.split(clean, rf"(?<=[{ends}])\s+"), lambda s: s != "")


def pack(pieces: Column, limit: int) -> Column:
    """Greedy packing: pieces are joined by blanks as long as they fit; a running length that starts anew with each pack."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, piece: Column) -> Column:
        joined = F.when(state["now"] == "", piece).otherwise(F.concat(state["now"], F.lit(" "), piece))
        full = (state["now"] != "") & (F.length(joined) > limit)
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"), F.when(full, piece).otherwise(joined).alias("now"))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def speech_chunks(text: Column, target: int = 480, most: int = 720) -> Column:
    """Chunks for speech: sentences, long ones cut between words, packed up to ``target`` characters."""
    parts = F.flatten(F.transform(sentences(text), lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(pack(F.split(s, " "), most))))
    return pack(parts, target)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def captions(text: Column, most: int = 116, tolerance: int = 28, tail: int = 34) -> Column:
    """Captions of up to ``most`` characters that never cross a sentence.

    A sentence's last caption is a scrap if it has fewer than three words or ``tail`` characters. It gets as few words as make it
    whole from the caption before, which keeps three at least; with them it may be ``tolerance`` longer than the others.
    """
    clean = F.regexp_replace(T.squeeze(F.coalesce(text, F.lit(""))), r"\s+([,.;:!?])", "$1")

    def balanced(lines: Column) -> Column:
        n = F.size(lines)
        ends = F.struct(_words(F.get(lines, n - 2)).alias("before"), _words(F.get(lines, n - 1)).alias("last"))
        return F.when(n > 1, F.concat(F.slice(lines, F.lit(1), n - 2), _let(ends, lambda e: tail_of(e["before"], e["last"])))).otherwise(lines)

    def tail_of(before: Column, last: Column) -> Column:
        spare = F.greatest(F.lit(0), F.size(before) - 3)
        moved = lambda m: F.concat(F.slice(before, F.size(before) - m + 1, m), last)
        long = lambda m: F.length(F.array_join(moved(m), " "))
        done = lambda m: ~((F.size(last) + m < 3) | (long(m) < tail)) | (m >= spare) | (long(m + 1) > most + tolerance)
        least = F.array_min(F.filter(F.sequence(F.lit(0), spare), done))
        return _let(least, lambda m: F.array(F.array_join(F.slice(before, F.lit(1), F.size(before) - m), " "), F.array_join(moved(m), " ")))

    each = F.filter(F.split(clean, r"(?<=[.!?])\s+"), lambda s: s != "")
    return F.flatten(F.transform(each, lambda s: _let(pack(_words(s), most), balanced)))


def evidence_chunks(text: Column, most: int = 3600, overlap_lines: int = 4, overlap: int = 500) -> Column:
    """Chunks of whole lines up to ``most`` characters; each begins with the last lines of the one before. Longer lines are first cut with an overlap.

    Lengths are summed once, so that a chunk is a pair of places; a fold over the lines finds the places where chunks end.
    """
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    step = most - overlap

    def pieces(line: Column) -> Column:
        more = F.greatest(F.lit(0), F.ceil((F.length(line) - most) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), more), lambda k: F.substring(line, k * step + 1, F.lit(most)))

    lines = F.filter(F.transform(F.split(whole, r"\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return _windows(F.flatten(F.transform(lines, pieces)), most, overlap_lines)


def _windows(lines: Column, most: int, overlap_lines: int) -> Column:
    def over(lines: Column) -> Column:
        sums = F.aggregate(lines, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
        return _let(sums, lambda sums: cut(lines, sums))

    def cut(lines: Column, sums: Column) -> Column:
        fits = lambda a, b: F.get(sums, b + 1) - F.get(sums, a) - 1 <= most
        start = F.struct(F.lit(0).alias("from"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))

        def place(state: Column, at: Column) -> Column:
            # the chunk ends in front of line ``at``; those after it begin a few lines earlier, as late as it takes for the line to fit
            least = F.greatest(state["from"] + 1, at - overlap_lines)
            onward = F.array_min(F.filter(F.sequence(least, at), lambda x: fits(x, at) | (x == at)))
            between = F.transform(F.filter(F.sequence(least, at), lambda x: x < onward), lambda x: F.struct(x.alias("a"), at.alias("b")))
            ended = F.struct(onward.alias("from"), F.concat(state["done"], F.array(F.struct(state["from"].alias("a"), at.alias("b"))), between).alias("done"))
            return F.when(fits(state["from"], at) | (state["from"] == at), state).otherwise(ended)

        places = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda n: n < F.size(lines))
        all_ = F.aggregate(places, start, place, lambda s: F.concat(s["done"], F.array(F.struct(s["from"].alias("a"), F.size(lines).alias("b")))))
        return F.transform(all_, lambda c: F.array_join(F.slice(lines, c["a"] + 1, c["b"] - c["a"]), "\n"))

    return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(_let(lines, over))
