"""Schemas of the canonical tables."""

from __future__ import annotations

FILES = "path string, language string, content_hash string, indexed_at bigint"
SYMBOLS = "name string, qualified_name string, kind string, file_path string, line_start int, line_end int, col_start int, col_end int"
REFS = "from_file string, from_symbol string, to_name string, to_name_tail string, kind string, line int, col int"
GIT_FILES = "path string, churn_score double, fix_count bigint, total_commits bigint, last_commit_at bigint"
PAIRS = "file_a string, file_b string, weight double, count bigint, last_observed_at bigint"
COMMITS = "commit_id string, ts bigint, subject string"
FILE_CHANGES = "commit_id string, path string, added bigint, deleted bigint"
CHUNKS = "chunk_id bigint, file_path string, language string, content string, start_line int, end_line int, embedding array<float>"

LANGUAGES = ("php", "python", "c", "cpp", "rust", "javascript", "typescript", "go")
LANGUAGE_ALIASES = {"c++": "cpp", "cxx": "cpp", "js": "javascript", "ts": "typescript"}
SYMBOL_KINDS = ("function", "method", "class", "trait", "interface", "struct", "enum", "constant", "macro", "module", "namespace")
REFERENCE_KINDS = ("import", "include", "call", "instantiation", "inheritance", "trait_use", "type_hint")


def checked(column, allowed: tuple[str, ...], what: str):
    """column, with an error at run time for a value outside a closed domain."""
    from pyspark.sql import functions as F

    return F.when(column.isNull() | column.isin(*allowed), column).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), column)))
