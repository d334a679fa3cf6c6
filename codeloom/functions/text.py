"""Column functions on text: tokens and identifiers."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


@cache
def _accents() -> tuple[str, str]:
    """Letters below U+2000 that decompose into a base letter and marks, and their bases."""
    pairs = [(c, d[0]) for c in map(chr, range(0x80, 0x2000)) for d in [unicodedata.normalize("NFD", c)] if len(d) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, without accents, whether these are part of a letter or stand behind it."""
    plain = F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), *_accents())
    return F.filter(F.split(plain, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def looks_like_code(token: Column) -> Column:
    return token.rlike("[_A-Z0-9]")


def looks_like_identifier(token: Column) -> Column:
    start = token.rlike(r"^[\p{L}_]")
    plain = token.rlike(r"^[\p{L}\p{N}_]*$") & (F.octet_length(token) >= 4)
    return start & (token.contains("_") | token.rlike(r"\p{Lu}") | plain)


def identifiers(text: Column, shortest: int = 3) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), lambda t: F.length(t) >= shortest))


def dotted_pairs(text: Column) -> Column:
    """``a.b`` with both sides identifiers of three or more characters; a side is used once."""
    return F.regexp_extract_all(text, F.lit(r"(?:[A-Za-z_]\w{2,})\.(?:[A-Za-z_]\w{2,})"), F.lit(0))


def gate_tokens(query: Column) -> Column:
    trimmed = F.transform(F.split(query, r"[|\s,;]+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda t: t != ""))


def match_terms(query: Column) -> Column:
    """The terms of a keyword query: dotted pairs first, then tokens that look like code, each once whatever its case."""
    dotted = F.flatten(F.transform(dotted_pairs(query), lambda d: F.split(d, r"\.")))
    coded = F.filter(F.split(query, r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) >= 2) & looks_like_code(t))
    return F.array_distinct(F.transform(F.concat(dotted, coded), lambda t: F.lower(t)))
