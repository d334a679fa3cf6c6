"""Symbols and references of source files, for eight languages, run in Python workers.

Python is parsed by its own ``ast``. The declarations of the other languages are found by a scan of tokens (``declarations``); their references by
patterns over lines, with comments blanked out first. That covers ordinary code; it is no full grammar (macros that open blocks are
missed, and a type is listed where it is defined, not where it is named).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..schemas import REFS, SYMBOLS
from . import declarations

_ID = r"[A-Za-z_][A-Za-z0-9_]*"
USED = {
    "php": [("instantiation", r"\bnew\s+([\w\\]+)"), ("call", rf"(?<!function )(?:->|::|\b)({_ID})\s*\(")],
    "rust": [("import", r"^\s*(?:pub\s+)?use\s+([\w:]+)"), ("inheritance", rf"\bimpl(?:<[^>]*>)?\s+({_ID}(?:::{_ID})*)(?:<[^>]*>)?\s+for\b"), ("call", rf"(?<!fn )\b({_ID}(?:::{_ID})*)\s*\("), ("call", rf"\b(?!macro_rules\b)({_ID}(?:::{_ID})*)!\s*[\(\[\{{]")],
    "go": [("import", r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$'), ("call", rf"(?<!func )\b({_ID}(?:\.{_ID})?)\s*\(")],
    "javascript": [("import", r"\bfrom\s+['\"]([^'\"]+)['\"]"), ("import", r"\brequire\(\s*['\"]([^'\"]+)['\"]"), ("instantiation", rf"\bnew\s+({_ID})"), ("inheritance", rf"\bextends\s+({_ID})"), ("call", rf"(?<!function )\b({_ID})\s*\(")],
    "c": [("include", r'^\s*#\s*include\s+(<[^>]+>|"[^"]+")'), ("call", rf"\b({_ID})\s*\(")],
}
USED["typescript"] = USED["javascript"]
USED["cpp"] = [USED["c"][0], ("import", rf"^\s*using\s+(?!namespace\b|typename\b)({_ID}(?:::{_ID})*)\s*;"), ("instantiation", rf"\bnew\s+({_ID})"), ("call", rf"\b({_ID}(?:::{_ID})*)\s*\(")]
#: Clauses that name several others, wherever their lines break: what begins one, and what kind of reference it makes.
_NAMES = r"[\w\\:<>,\s]+?"
CLAUSES = {
    "php": [("inheritance", rf"\b(?:extends|implements)\s+({_NAMES})(?=\bimplements\b|\{{)")],
    "cpp": [("inheritance", rf"\b(?:class|struct)\s+{_ID}(?:\s+final)?\s*:(?!:)({_NAMES})\{{")],
}
NOT_CALLS = {"if", "for", "while", "switch", "return", "catch", "sizeof", "match", "function", "elseif", "foreach", "isset", "array", "func", "fn"}


def _blank(text: str, lang: str) -> str:
    """The text with comments and the insides of strings as spaces, lines kept."""
    hide = lambda m: re.sub(r"[^\n]", " ", m.group(0))
    text = re.sub(r"/\*.*?\*/", hide, text, flags=re.S)
    text = re.sub(r"(?m)//[^\n]*$", hide, text)
    if lang == "php":
        text = re.sub(r"(?m)#(?!\[)[^\n]*$", hide, text)
    return text


def symbols_of(path: str, lang: str, text: str) -> list[tuple]:
    """(name, qualified_name, kind, file_path, line_start, line_end, col_start, col_end); lines from 1, columns from 0."""
    return _python_symbols(path, text) if lang == "python" else declarations.symbols_of(path, lang, text)


def _python_symbols(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []

    def walk(node: ast.AST, owner: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if owner else "function"
                out.append((x.name, f"{owner}.{x.name}" if owner else x.name, kind, path, x.lineno, x.end_lineno, x.col_offset, x.end_col_offset))
                walk(x, x.name if isinstance(x, ast.ClassDef) else None)
            else:
                walk(x, owner)

    walk(tree, None)
    return sorted(out, key=lambda s: (s[4], s[6]))


def references_of(path: str, lang: str, text: str) -> list[tuple]:
    """(from_file, from_symbol, to_name, to_name_tail, kind, line, col); the symbol is left null."""
    out = []
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        for x in ast.walk(tree):
            if isinstance(x, ast.Import):
                out += [(a.name, "import", x.lineno, x.col_offset) for a in x.names]
            elif isinstance(x, ast.ImportFrom):
                out.append((x.module or "." * x.level, "import", x.lineno, x.col_offset))
            elif isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)):
                out.append((x.func.id if isinstance(x.func, ast.Name) else x.func.attr, "call", x.lineno, x.col_offset))
            elif isinstance(x, ast.ClassDef):
                out += [(b.id, "inheritance", b.lineno, b.col_offset) for b in x.bases if isinstance(b, ast.Name)]
    else:
        for k, line in enumerate(_blank(text, lang).split("\n")):
            for kind, pattern in USED[lang]:
                for m in re.finditer(pattern, line):
                    if kind != "call" or m[1] not in NOT_CALLS:
                        out.append((m[1].strip('"'), kind, k + 1, m.start(1)))
        out += _named_in_clauses(lang, _blank(text, lang))
        if lang == "php":
            out += _php_uses(path, _blank(text, lang), text)
    tail = re.compile(r"(?s)^.*(?:[\\/]|::)")
    return [(path, None, n, tail.sub("", n), kind, line, col) for n, kind, line, col in sorted(out, key=lambda r: (r[2], r[3]))]


def _placed(text: str, names: list[tuple[str, int]], kind: str) -> list[tuple]:
    return [(n, kind, text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at) - 1) for n, at in names]


def _named_in_clauses(lang: str, text: str) -> list[tuple]:
    """The names of a clause each, without access words and without what stands in angle brackets."""
    out = []
    for kind, pattern in CLAUSES.get(lang, ()):
        for m in re.finditer(pattern, text):
            bare = re.sub(r"<[^<>]*>", lambda g: " " * len(g[0]), re.sub(r"<[^<>]*>", lambda g: " " * len(g[0]), m[1]))
            names = [(n[0], m.start(1) + n.start()) for n in re.finditer(r"[A-Za-z_\\][\w\\:]*", bare) if n[0] not in ("public", "private", "protected", "virtual")]
            out += _placed(text, names, kind)
    return out


def _php_uses(path: str, text: str, whole: str) -> list[tuple]:
    """``use`` inside a class is of traits, outside of namespaces, there also in groups and under other names."""
    types = [s[4:6] for s in symbols_of(path, "php", whole) if s[2] in ("class", "trait", "enum")]
    out = []
    for m in re.finditer(r"(?m)^[ \t]*use\s+(?:function\s+|const\s+)?([^;({]+)(?:\{([^}]*)\})?\s*[;{]", text):
        line = text.count("\n", 0, m.start(1)) + 1
        inside = any(a < line <= b for a, b in types)
        parts = [(p[1], m.start(2) + p.start(1)) for p in re.finditer(r"([\w\\]+)(?:\s+as\s+\w+)?", m[2])] if m[2] and not inside else [(p[1], m.start(1) + p.start(1)) for p in re.finditer(r"([\w\\]+)(?:\s+as\s+\w+)?", m[1])]
        before = m[1].strip() if m[2] and not inside else ""
        out += [(before + n, k, at, col) for n, k, at, col in _placed(text, parts, "trait_use" if inside else "import")]
    return out


def _mapped(files: DataFrame, extract, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, g, c in zip(b["path"], b["language"], b["content"], strict=True):
                text = c.decode("utf-8", "replace") if isinstance(c, (bytes, bytearray, memoryview)) else c or ""
                rows += extract(p, g, text) if g in USED or g == "python" else []
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "language", "content").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    return _mapped(files, symbols_of, SYMBOLS)


def references(files: DataFrame) -> DataFrame:
    return _mapped(files, references_of, REFS)
