"""Column functions on names and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tail(name: Column) -> Column:
    """What follows the right-most of ``\\``, ``/`` and ``::``."""
    return F.regexp_replace(name, r"(?s)^.*(?:[\\/]|::)", "")


def model_table_name(model: Column, dim: Column) -> Column:
    return F.concat(F.lit("chunks_"), F.regexp_replace(model, r"[^\p{L}\p{N}]", "_"), F.lit("_"), dim.cast("string"))


def slugify(text: Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.substring(s, 1, most)


def preview(text: Column, most: int = 120) -> Column:
    return F.regexp_replace(F.substring(text, 1, most), r"\n", " ")


def middle_cut(text: Column, longest: int = 4096, side: int = 1024) -> Column:
    n = F.length(text)
    cut = F.concat(F.substring(text, 1, side), F.lit("\n...["), (n - 2 * side).cast("string"), F.lit(" chars]...\n"), F.right(text, F.lit(side)))
    return F.when(n > longest, cut).otherwise(text)


def short_sha(sha: Column) -> Column:
    return F.when(sha.rlike("^[0-9a-fA-F]{12,}$"), F.substring(sha, 1, 12)).otherwise(sha)


def is_fix(subject: Column) -> Column:
    from ..config import FIX_PARTS, FIX_PREFIXES

    s = F.lower(subject)
    tests = [s.startswith(p) for p in FIX_PREFIXES] + [s.contains(p) for p in FIX_PARTS]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def is_skipped(subject: Column) -> Column:
    """Housekeeping subjects, unless they name a change that matters."""
    from ..config import RESCUE_WORDS, SKIP_PREFIXES

    s = F.lower(subject)
    prefix, rescue = F.lit(False), F.lit(False)
    for p in SKIP_PREFIXES:
        prefix = prefix | s.startswith(p)
    for w in RESCUE_WORDS:
        rescue = rescue | s.contains(w)
    return prefix & ~rescue


def rename_target(path: Column) -> Column:
    """``a/{x => y}/z`` becomes ``a/y/z``; an empty side leaves no doubled slash."""
    moved = F.regexp_replace(path, r"^([^{]*)\{[^}]*? => ([^}]*)\}(.*)$", "$1$2$3")
    return F.when(path.rlike(r"\{[^}]* => [^}]*\}"), F.regexp_replace(moved, "//", "/")).otherwise(path)
