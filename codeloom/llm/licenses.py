"""Operator 8, license scans: an Aho-Corasick automaton finds identifier tags and notice phrases, and a shunting-yard parser
evaluates the license expressions that follow tags.

Words are taken as the contract has them: A-Z lower-cased, then runs of digits, letters a-z and anything beyond ASCII. The
automaton runs over a text's words joined by single spaces, so a phrase matches only whole consecutive words.

An expression joins identifiers by ``and``, ``or`` and ``with`` (in rising order of binding: or, and, with). Its value is
the strength of its obligations, 0 permissive to 3 network copyleft: ``or`` lets the licensee choose the weaker side,
``and`` asks for both, so the stronger counts, and an exception joined by ``with`` turns strong into weak copyleft.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The contract's phrases and labels (fixed values).
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notice phrases that the method adds, with the identifier each stands for.
NOTICE_PHRASES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa": "cc-by-sa",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc": "cc-by-nc",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0-1.0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"

#: Strength of obligations by the start of an identifier; the longest start that fits counts, and others count as 2.
STRENGTH = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "bsl": 0, "zlib": 0, "unlicense": 0, "cc0": 0, "cc-by": 0, "0bsd": 0,
    "mpl": 1, "lgpl": 1, "epl": 1, "cddl": 1,
    "gpl": 2, "cc-by-sa": 2, "cc-by-nc": 2, "cc-by-nd": 2,
    "agpl": 3, "sspl": 3,
}
CLASSES = ("permissive", "weak-copyleft", "strong-copyleft", "network-copyleft")
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes(32 if b in SEPARATORS else b for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_LEAD = re.compile(r"[ \t:]*")
_BINDING = {"or": 1, "and": 2, "with": 3}


def strength(identifier: str) -> int:
    i = identifier.lower()
    fits = [k for k in STRENGTH if i.startswith(k)]
    return STRENGTH[max(fits, key=len)] if fits else 2


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None for an expression that is not well formed."""
    out: list[str] = []
    ops: list[str] = []
    operand = True  # whether an operand must come next
    for t in tokens:
        low = t.lower()
        if t == "(":
            if not operand:
                return None
            ops.append(t)
        elif t == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif low in _BINDING:
            if operand:
                return None
            while ops and ops[-1] != "(" and _BINDING[ops[-1]] >= _BINDING[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(expression: str) -> tuple[int, list[str]] | None:
    """(strength, license identifiers, lower-cased) of an expression; None where it is not well formed."""
    tokens = _TOKEN.findall(expression)
    postfix = to_postfix(tokens)
    if postfix is None:
        return None
    stack: list[tuple[int | None, list[str]]] = []
    for t in postfix:
        if t not in _BINDING:
            stack.append((strength(t), [t.lower()]))
            continue
        (b, names_b), (a, names_a) = stack.pop(), stack.pop()
        if t == "with":
            if len(names_b) > 1:
                return None  # an exception is one name
            stack.append((1 if a == 2 else a, names_a))
            continue
        few, many = sorted((names_a, names_b), key=len)
        many += few  # the shorter list moves, so a long chain costs little more than its length
        stack.append((min(a, b) if t == "or" else max(a, b), many))
    return stack[0]


def leading_expression(text: str, start: int = 0, end: int | None = None) -> str:
    """As much of text[start:end] as can belong to an expression: identifiers must be joined by operators. Nothing beyond it is read."""
    out: list[str] = []
    operand, depth = True, 0
    for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
        t = m[0]
        if t == "(" and operand:
            depth += 1
        elif t == ")" and not operand and depth:
            depth -= 1
        elif t.lower() in _BINDING and not operand:
            operand = True
        elif t not in "()" and t.lower() not in _BINDING and operand:
            operand = False
        else:
            break
        out.append(t)
    return " ".join(out)


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None) -> dict:
    """n_words, places [(phrase, first word)], base and all labels, expressions [(text, strength or None)] and score of a text."""
    raw = text or ""
    words = raw.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w]
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    places, tags = [], []
    seen, at = 0, 0
    for end, phrase in _automaton().iter(joined):
        start = end - len(phrase) - 1
        # starts need not rise from match to match, so the count goes on from the earlier place or steps back
        seen += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
        at = start
        (tags if phrase == TAG else places).append((phrase, seen))
    base = [(p, k) for p, k in places if p in BASE_PHRASES]
    labels = {BASE_PHRASES[p] for p, _ in base}
    own = {NOTICE_PHRASES[p] for p, _ in places if p in NOTICE_PHRASES}
    expressions = []
    if tags:
        spans = [m.end() for m in _WORD.finditer(raw.translate(_FOLD))]
        line_end = -1
        for _, k in tags:  # in the order of the text, so each line's end is looked for once
            start = _LEAD.match(raw, spans[k + 2]).end()
            if line_end < start:
                line_end = raw.find("\n", start) % (len(raw) + 1)
            found = leading_expression(raw, start, line_end)
            value = evaluate(found) if found else None
            expressions.append((found, value[0] if value else None))
            own |= set(value[1]) if value else {"spdx-malformed"}
    evidence = len({p for p, _ in places}) + 3 * sum(v is not None for _, v in expressions)
    return {
        "n_words": len(words),
        "base": base,
        "base_labels": sorted(labels),
        "labels": sorted(labels | own),
        "expressions": expressions,
        "score": 1 - 0.5**evidence,
    }


_FOLD = {c: c + 32 for c in range(65, 91)}


def scanned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, the counts and labels of the contract, ``license_class`` and ``expressions``.

    license_class is that of the strongest expression, else of the strongest label, else null; expressions lists what
    follows identifier tags. Defined results: a null or blank text has no words and no labels (empty strings) and score 0;
    a malformed expression gives the label spdx-malformed; a text of any length is scanned whole, in time that grows with its length; repeated rows repeat; an empty table gives an empty
    result; null ids and other columns make no difference.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, license_class string, expressions array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                x = scan(t)
                starts = [k for _, k in x["base"]]
                known = [v for _, v in x["expressions"] if v is not None] or [strength(n) for n in x["labels"] if n != "spdx-malformed"]
                rows.append((
                    x["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(x["base_labels"]), ",".join(x["labels"]),
                    x["score"], CLASSES[max(known)] if known else None, [e for e, _ in x["expressions"]],
                ))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_class", "expressions"])
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
