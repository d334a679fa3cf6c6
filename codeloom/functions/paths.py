"""Column functions on paths: globs, languages, categories, test conventions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALWAYS_EXCLUDED, DEFAULT_EXCLUDED, EXTENSIONS, TEST_LIKE


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ``*`` may cross ``/``, ``**/`` also stands for nothing, ``{a,b}`` and ``[...]`` work."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return out


def _search(glob: str) -> tuple[str, str] | None:
    """("at", x) or ("in", x): what to search for at the start of a segment, or anywhere, for a glob that begins with ``**/``; None for other globs."""
    body = glob.removeprefix("**/")
    if body == glob or not body or any(c in body for c in "?[]{}") or "**" in body.removesuffix("/**"):
        return None
    end = "/" if body.endswith("/**") else r"\z"
    body = body.removesuffix("/**")
    where = "in" if body.startswith("*") else "at"
    body = body.removeprefix("*")
    if body.endswith("*") and end == r"\z":
        body, end = body.removesuffix("*"), ""
    return where, ".*".join(re.escape(x) for x in body.split("*")) + end


def _either(patterns: Sequence[str]) -> str:
    """An alternation that looks at the first character once."""
    first = lambda p: p[: 1 + (p[0] == "\\")]
    groups = [(c, [p[len(c) :] for p in g]) for c, g in groupby(sorted(patterns, key=first), key=first)]
    return "(?:" + "|".join(c + (f"(?:{'|'.join(g)})" if len(g) > 1 else g[0]) for c, g in groups) + ")"


def any_glob(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path matches any of the globs.

    Most globs name a folder, a file or an ending, anywhere. These become one search that looks only behind slashes and at dots, so
    that the many default globs cost about as much as one; a full match of each would go over the path from every place.
    """
    found, rest = [_search(g) for g in globs], [g for g in globs if _search(g) is None]
    at, within = ([x for f in found if f and f[0] == k for x in [f[1]]] for k in ("at", "in"))
    dotted = [x.removeprefix(r"\.") for x in within if x.startswith(r"\.")]
    parts = (["(?:^|/)" + _either(at)] if at else []) + ([r"\." + _either(dotted)] if dotted else []) + [x for x in within if not x.startswith(r"\.")]
    tests = [path.rlike("(?s)" + "|".join(parts))] if parts else []
    if rest:
        tests.append(path.rlike("(?s)^(?:" + "|".join(glob_regex(g) for g in rest) + r")\z"))
    return reduce(or_, tests) if tests else F.lit(False)


def is_test_like(path: Column) -> Column:
    return any_glob(path, TEST_LIKE)


def is_hard_excluded(path: Column, extra: Sequence[str] = ()) -> Column:
    """Excluded from history; paths that look like tests stay."""
    return any_glob(path, [*ALWAYS_EXCLUDED, *extra])


def is_excluded(path: Column, extra: Sequence[str] = ()) -> Column:
    return any_glob(path, [*DEFAULT_EXCLUDED, *extra])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    """The file name up to its last dot; empty without one."""
    return F.regexp_extract(basename(path), r"^(.*)\.[^.]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)


def language_of(path: Column, header_is_cpp: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    found = F.try_element_at(table, extension(path))
    return found if header_is_cpp is None else F.when((extension(path) == "h") & header_is_cpp, F.lit("cpp")).otherwise(found)


def file_category(path: Column) -> Column:
    """test, config or source, by the path alone."""
    p = F.lower(path)
    test = p.rlike(r"(?:^|/)(?:tests?|__tests__|spec)/|\.(?:test|spec)\.(?:ts|tsx|js|jsx)$|test\.php$|_test\.(?:py|go)$|\.phpt$|(?:^|/)test_[^/]*$")
    config = p.rlike(r"\.(?:toml|yaml|yml|json|ini|env|conf)$")
    return F.when(test, F.lit("test")).when(config, F.lit("config")).otherwise(F.lit("source"))


# Where the test of a file may stand; {d} is its directory, {s} its name without extension.
SIBLINGS = (
    "{d}/{s}Test.php", "tests/Unit/{s}Test.php", "tests/Feature/{s}Test.php", "{d}/test_{s}.py", "{d}/{s}_test.py", "tests/test_{s}.py",
    "{d}/{s}_test.go", "{d}/{s}.test.ts", "{d}/{s}.test.tsx", "{d}/{s}.test.js", "{d}/{s}.spec.ts", "{d}/{s}.spec.tsx", "{d}/{s}.spec.js",
)
MIRRORS = ("tests/Unit/", "tests/Feature/", "tests/Integration/", "tests/Browser/")


def sibling_candidates(path: Column) -> Column:
    """Every path at which a test of this file would stand, by name conventions and mirrored trees."""
    d, s = dirname(path), stem(path)
    made = []
    for t in SIBLINGS:
        before, _, rest = t.partition("{s}")
        head = F.concat(d, F.lit(before[3:])) if before.startswith("{d}") else F.lit(before)
        made.append(F.ltrim(F.concat(head, s, F.lit(rest)), F.lit("/")))
    rest_dir = F.regexp_extract(path, r"^(?:app|src)/(.*)/[^/]*$", 1)
    nested = path.rlike(r"^(?:app|src)/.*/[^/]*\.php$") & (s != "")
    for m in MIRRORS:
        made.append(F.when(nested & path.startswith("app/"), F.concat(F.lit(m), rest_dir, F.lit("/"), s, F.lit("Test.php"))))
    made.append(F.when(nested & path.startswith("src/"), F.concat(F.lit("tests/"), rest_dir, F.lit("/"), s, F.lit("Test.php"))))
    return F.when(s != "", F.array_distinct(F.array_compact(F.array(*made)))).otherwise(F.array().cast("array<string>"))
