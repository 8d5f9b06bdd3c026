"""The same functions as DuckDB expressions, for comparing results."""

from __future__ import annotations

from quillon.functions import text as T


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(expression: str, rules: list[tuple[str, str]]) -> str:
    """A chain of replacements; inline flags become options, $1 becomes \\1."""
    for pattern, by in rules:
        options = "g"
        if pattern.startswith("(?"):
            flags, _, pattern = pattern[2:].partition(")")
            options += flags.replace("u", "")
        by = by.replace("$1", "\\1")
        expression = f"regexp_replace({expression}, {quote(pattern)}, {quote(by)}, '{options}')"
    return expression


def fold(x: str) -> str:
    return f"lower(replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'D'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s ]+', ' ', 'g'))"


def normalise_query(x: str) -> str:
    return f"trim({replaced(fold(f'replace({x}, chr(160), {quote(' ')})'), T.QUERY_RULES)})"


def normalise_plain(x: str, keep: str = "a-z0-9%/_.-") -> str:
    return f"trim(regexp_replace({fold(x)}, '[^{keep}]+', ' ', 'g'))"


def retrieval_tokens(x: str, stop: list[str] = T.STOP_WORDS) -> str:
    words = ", ".join(map(quote, stop))
    return f"list_filter(regexp_split_to_array({normalise_query(x)}, '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({words}))"


def significant_tokens(x: str, stop: list[str] = T.STOP_WORDS) -> str:
    same = ", ".join(map(quote, T.SYNONYMS))
    return f"list_distinct(list_transform({retrieval_tokens(x, stop)}, lambda t: CASE WHEN t IN ({same}) THEN '{T.SYNONYM}' ELSE t END))"


def number_key(x: str) -> str:
    return f"regexp_replace({fold(x)}, '[\\s ]+', '', 'g')"


def slug(x: str) -> str:
    return f"left(regexp_replace(regexp_replace({fold(x)}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 120)"


def storage_key(x: str) -> str:
    return f"left(regexp_replace(regexp_replace({number_key(x)}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 120)"


def canonical_number(x: str) -> str:
    return f"replace(replace(upper(regexp_replace(regexp_extract({x}, {quote(T.FULL_NUMBER[5:])}, 0, 'i'), '\\s+', '', 'g')), 'ND-CP', 'NĐ-CP'), 'QD-', 'QĐ-')"


def tidy(x: str) -> str:
    return f"regexp_replace({replaced(x, T.SPACE_RULES)}, '^[\\s ﻿]+|[\\s ﻿]+$', '', 'g')"


def decode_named(x: str) -> str:
    return replaced(x, [(f"(?i){a}", b) for a, b in [*T.NAMED, ("&amp;", "&")]])


def html_to_text(x: str) -> str:
    return tidy(decode_named(replaced(x, T.MARKUP_RULES)))


def header_key(x: str) -> str:
    return normalise_plain(f"coalesce({x}, '')", "a-z0-9")
