"""Text normalisation, identifiers and markup as Spark columns: folding, typo repair, tokens, numbers, URLs, HTML to text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_pairs() -> tuple[str, str]:
    """Letters that decompose into a base letter and combining marks, and their base letters; đ joins them."""
    source, target = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(point))
        base = "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base != chr(point):
            source.append(chr(point))
            target.append(base)
    return "".join(source) + "đĐ", "".join(target) + "dD"


FOLD_FROM, FOLD_TO = _fold_pairs()
COMBINING = "".join(map(chr, range(0x300, 0x370)))


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """A chain of regular-expression replacements, in order."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def where_has(text: Column, marks: list[str], change: Callable[[Column], Column]) -> Column:
    """``change`` of texts that hold one of ``marks``, without which it would change nothing: a plain search takes a twentieth of a regular expression's time."""
    return let(text, lambda t: F.when(reduce(Column.__or__, [F.contains(t, F.lit(m)) for m in marks]), change(t)).otherwise(t))


def replaced_where(text: Column, marks: list[str], pattern: str, by: str) -> Column:
    """A regular-expression replacement that matches only in texts that hold one of ``marks``."""
    return where_has(text, marks, lambda t: F.regexp_replace(t, pattern, by))


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def fold(text: Column) -> Column:
    """Accents dropped, đ as d, lower case; texts of ASCII alone have none. Letters that ``translate`` has no counterpart for are dropped: the combining marks."""
    return let(text, lambda t: F.lower(F.when(F.length(t) == F.octet_length(t), t).otherwise(F.translate(t, FOLD_FROM + COMBINING, FOLD_TO))))


#: White space but for the blank, with the no-break space.
OTHER_SPACES = list("\t\n\x0b\f\r\xa0")


def squeeze(text: Column) -> Column:
    """White space (with no-break space) folded to single spaces, trimmed. Plain replacements; a regular expression only where blanks stand together."""
    for space in OTHER_SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.trim(replaced_where(text, ["  "], " {2,}", " "))


#: Typo repair and abbreviations of the query normaliser, in order.
QUERY_RULES = [
    (r"nghi\s+(?:dinh|didnh|dihn|dinhh)", "nghi dinh"),
    (r"thong\s+tu", "thong tu"),
    (r"nghi\s+quyet", "nghi quyet"),
    (r"quyet\s+dinh", "quyet dinh"),
    (r"quan\s+l[iy]", "quan ly"),
    (r"\bgtgt\b", "gia tri gia tang"),
    (r"\btncn\b", "thu nhap ca nhan"),
    (r"\btndn\b", "thu nhap doanh nghiep"),
    (r"\btmdt\b", "thuong mai dien tu"),
    (r"\bnd\s*[- ]?\s*cp\b", "nd-cp"),
    (r"\btt\s*[- ]?\s*btc\b", "tt-btc"),
    (r"\bnq\s+(qh|cp)\b", "nq-$1"),
    (r"[^a-z0-9/_.-]+", " "),
    (r"\s+", " "),
]


#: What a text must hold for each of ``QUERY_RULES`` but the last two to match.
QUERY_MARKS = ["nghi", "thong", "nghi", "quyet", "quan", "gtgt", "tncn", "tndn", "tmdt", "cp", "btc", "nq"]


def normalise_query(text: Column) -> Column:
    """``QUERY_RULES`` on a folded text; where the last but one has run, white space is single blanks, so the last one has nothing to do."""
    text = fold(F.replace(text, F.lit("\xa0"), F.lit(" ")))
    for mark, (pattern, by) in zip(QUERY_MARKS, QUERY_RULES[:-2], strict=True):
        text = replaced_where(text, [mark], pattern, by)
    return F.trim(F.regexp_replace(text, *QUERY_RULES[-2]))


def normalise_plain(text: Column, keep: str = "a-z0-9%/_.-") -> Column:
    """Folded text with everything outside ``keep`` turned into single spaces."""
    return F.trim(F.regexp_replace(fold(text), f"[^{keep}]+", " "))


#: Words that retrieval ignores.
STOP_WORDS = "thue van ban quy dinh muc dong doi voi nguoi nganh hang hien hanh nam the nao nhu can lam gi toi muon tim hieu chi tiet ve va hay cua co khong cho".split()
SYNONYMS = ["streamer", "streaming", "youtuber", "tiktoker"]
SYNONYM = "contentcreator"


def once(expression: Column) -> Column:
    """An expression that later columns use several times: exploding a one-element array keeps the optimiser from copying it into each of them."""
    return F.explode(F.array(expression))


def says(normalised: Column, pattern: str) -> Column:
    """``rlike``; where the pattern is a list of phrases, plain searches for them come first, since most texts have none and a regular expression takes twenty times as long."""
    listed = re.fullmatch(r"\\b\(\?:([a-z0-9 |-]+)\)\\b", pattern)
    if not listed:
        return normalised.rlike(pattern)
    return reduce(Column.__or__, [F.contains(normalised, F.lit(x)) for x in listed[1].split("|")]) & normalised.rlike(pattern)


def tokens_of(normalised: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Tokens of two letters and more of a normalised text that aren't stop words, in order, repeats kept."""
    return F.filter(F.split(normalised, "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(stop))


def distinct_tokens(tokens: Column) -> Column:
    """Distinct tokens in order, synonyms collapsed."""
    return F.array_distinct(F.transform(tokens, lambda t: F.when(t.isin(SYNONYMS), SYNONYM).otherwise(t)))


def retrieval_tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Tokens of a raw text."""
    return tokens_of(normalise_query(text), stop)


def significant_tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Distinct tokens of a raw text."""
    return distinct_tokens(retrieval_tokens(text, stop))


def number_key(text: Column) -> Column:
    """Business key of a document number: folded, without spaces."""
    return unspaced(fold(text))


def unspaced(folded: Column) -> Column:
    for space in [" ", *OTHER_SPACES]:
        folded = F.replace(folded, F.lit(space), F.lit(""))
    return folded


def slug(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(120))


def storage_key(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(number_key(text), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(120))


#: Fixed value: a full document number in capitals or small letters (``u`` folds Đ too); the left boundary is ASCII, as all digits are.
FULL_NUMBER = r"(?iu)\b\d{1,4}\s*/\s*20\d{2}\s*/\s*(?:NĐ-CP|ND-CP|TT-[A-ZĐ0-9-]+|NQ-[A-ZĐ0-9-]+|QĐ-[A-ZĐ0-9-]+|QD-[A-Z0-9-]+|QH\d*|UBTVQH\d*)"


def canonical_number(text: Column) -> Column:
    """The first full document number of a text in canonical spelling; empty if none."""
    found = F.upper(F.regexp_replace(F.regexp_extract(text, FULL_NUMBER, 0), r"\s+", ""))
    return F.regexp_replace(F.regexp_replace(found, "ND-CP", "NĐ-CP"), "QD-", "QĐ-")


TRACKING = r"(?i)^(?:utm_.+|fbclid|gclid|ref|source)$"


def canonical_url(url: Column) -> Column:
    """https URLs without fragment, tracking parameters, www. and trailing slashes, parameters sorted by name; others empty."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i)https://([^/?#]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"^(?i)https://[^/?#]+([^?#]*)", 1)
    path = F.when(F.length(path) <= 1, F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_replace(p, "=.*$", "").rlike(TRACKING))
    sorted_ = F.transform(F.array_sort(F.transform(kept, lambda p, n: F.struct(F.regexp_replace(p, "=.*$", "").alias("name"), n.alias("nth"), p.alias("whole")))), lambda s: s["whole"])
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(sorted_, "&"))).otherwise("")
    return F.when(host == "", "").otherwise(F.concat(F.lit("https://"), host, path, tail))


def allowed_source(url: Column, hosts: list[str], roots: list[str]) -> Column:
    """https URLs of an exact host or of a root domain and its subdomains."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https://([^/?#:]+)", 1))
    ok = host.isin([*hosts, *roots])
    for root in roots:
        ok = ok | host.endswith("." + root)
    return F.coalesce(ok, F.lit(False))


#: Line-end and blank rules of extracted text, in order.
SPACE_RULES = [("\r\n?", "\n"), ("[\t ]+", " "), (" {2,}", " "), ("\n{3,}", "\n\n")]
JS_SPACE = "[\\s ﻿]"


SPACE_MARKS = [["\t", "\xa0"], ["  "], ["\n\n\n"]]
#: What a text that loses white space begins or ends with, and other line ends: ``$`` stands before a last one of these, too.
EDGES, LINE_ENDS = [" ", *OTHER_SPACES, "\ufeff"], ["\x85", "\u2028", "\u2029"]


def strip(text: Column) -> Column:
    """White space off both ends: trimmed, which looks at the ends alone, but for texts that end with another line end."""

    def stripped(t: Column) -> Column:
        ends = lambda test, marks: reduce(Column.__or__, [test(t, F.lit(m)) for m in marks])
        whole = F.when(ends(F.endswith, LINE_ENDS), F.regexp_replace(t, f"^{JS_SPACE}+|{JS_SPACE}+$", ""))
        return whole.when(ends(F.startswith, EDGES) | ends(F.endswith, EDGES), F.btrim(t, F.lit("".join(EDGES)))).otherwise(t)

    return let(text, stripped)


def tidy(text: Column) -> Column:
    """Newlines unified, blanks and blank lines folded, ends trimmed."""
    text = unix_lines(text)
    for marks, (pattern, by) in zip(SPACE_MARKS, SPACE_RULES[1:], strict=True):
        text = replaced_where(text, marks, pattern, by)
    return strip(text)


NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")]


def decode_named(text: Column) -> Column:
    """The named references that the extractor knows; ``&amp;`` last, so that nothing is decoded twice."""
    for name, by in NAMED:
        text = F.regexp_replace(text, f"(?i){name}", by)
    return F.regexp_replace(text, "(?i)&amp;", "&")


#: Markup rules: scripts and styles out, block ends to newlines, tags to blanks.
MARKUP_RULES = [
    (r"(?is)<script\b[^>]*>.*?</script>", " "),
    (r"(?is)<style\b[^>]*>.*?</style>", " "),
    (r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)>", "\n"),
    (r"<[^>]+>", " "),
]


def html_to_text(html: Column) -> Column:
    return tidy(decode_named(replace_all(html, MARKUP_RULES)))


def clean_user_query(text: Column) -> Column:
    """Control characters and runs of white space to single blanks."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]", " "))


def header_key(text: Column) -> Column:
    """A spreadsheet header for comparison."""
    return normalise_plain(F.coalesce(text, F.lit("")), "a-z0-9")


def compact_excerpt(text: Column, limit: int, least: int | None = None) -> Column:
    """At most ``limit`` characters, cut behind the last sentence end if that keeps more than ``least`` (half)."""
    least = limit // 2 if least is None else least
    clean = squeeze(text)
    head = F.left(clean, F.lit(limit))
    stop = F.length(F.regexp_extract(head, r"(?s)^(.*[.;])[\s]", 1))
    return F.when(F.length(clean) <= limit, clean).when(stop > least, F.left(head, stop)).otherwise(F.concat(F.rtrim(head), F.lit("…")))
