"""Column functions on requests: what a question, a search pattern, a path or a number in a tool call means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BUDGET_CHARS

# fixed values: openings that make a message no search, and phrases one of which a search holds
SKIPPED_OPENINGS = ("continue", "yes", "no", "ok", "thanks", "go ahead", "stop", "git ", "cargo ", "npm ", "pip ", "/", "!", "base directory")
SEARCH_SIGNALS = (
    "where", "find", "how does", "how do", "what is", "what are", "which file", "which class", "which function", "which method",
    "show me", "look at", "look for", "search", "implementation", "handler", "controller", "service",
    "component", "module", "route", "endpoint", "config", "setup", "initialize", "bootstrap",
    "error", "bug", "fix", "issue", "crash", "fail", "auth", "login", "session", "token", "permission",
    "database", "migration", "schema", "model", "debug", "trace", "log", "api", "request", "response", "middleware",
    "upload", "download", "document", "validation", "form", "input", "field", "can you", "need to", "want to", "trying to",
    "understand", "explain", "figure out", "investigate", "check", "review", "analyze", "explore",
)
SHORTEST_SEARCH, LONGEST_SEARCH = 15, 500
# fixed values: what a response that was cut tells its reader, where it is a list and where it is an object
CUT_LIST = "output exceeded budget; refine query, narrow scope (paths/language), or call with offset to paginate"
CUT_OBJECT = "output exceeded budget; refine query or narrow scope"


def _literal(words: tuple[str, ...]) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


def is_search_query(text: Column) -> Column:
    """Whether a message asks for code: of fitting length without its tagged parts, no command, and with a word of search. Null: false."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]+>.*?</[^>]+>", ""), r"^\s+|\s+$", "")
    low = F.lower(bare)
    asks = F.length(bare).between(SHORTEST_SEARCH, LONGEST_SEARCH) & ~low.rlike(f"^(?:{_literal(SKIPPED_OPENINGS)})") & low.rlike(_literal(SEARCH_SIGNALS))
    return F.coalesce(asks, F.lit(False))


def is_identifier_pattern(pattern: Column) -> Column:
    """Whether a search pattern is nothing but identifiers, split by blanks and bars. Null: false."""
    names = r"\s*[A-Za-z_][A-Za-z0-9_]*(?:\s+[A-Za-z_][A-Za-z0-9_]*)*\s*"
    return F.coalesce((F.length(pattern) >= 2) & pattern.rlike(rf"^{names}(?:\|{names})*\z"), F.lit(False))


def has_many_identifiers(pattern: Column) -> Column:
    """Of a pattern of identifiers: whether it holds more than one."""
    return is_identifier_pattern(pattern) & (pattern.contains("|") | (F.size(F.split(F.trim(pattern), r"\s+")) > 1))


def path_in_project(path: Column, root: str) -> Column:
    """A path relative to the project; null outside of it and for hidden files."""
    rest = F.regexp_replace(F.substring(path, len(root) + 1, 1 << 30), "^/+", "")
    return F.when(path.startswith(root) & (rest != "") & ~rest.startswith("."), rest)


def mentioned_paths(text: Column) -> Column:
    """The distinct values of ``file_path`` fields in a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r'"file_path"\s*:\s*"([^"]+)"'), F.lit(1)))


def target_kind(hint: Column, is_file: bool | None = None) -> Column:
    """``file`` or ``symbol``; without an explicit flag a slash or a dot makes it a file."""
    if is_file is not None:
        return F.when(hint.isNotNull(), F.lit("file" if is_file else "symbol"))
    return F.when(hint.contains("/") | hint.contains("."), F.lit("file")).when(hint.isNotNull(), F.lit("symbol"))


def count_of(text: Column) -> Column:
    """A whole number of at least 0 written as a number or a string; null where blank or no such number."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t.rlike(r"^\+?[0-9]+$"), t.try_cast("bigint"))


def bytes_text(n: Column) -> Column:
    """Bytes for people: B, KiB, MiB or GiB, with two decimals from KiB on."""

    def scaled(bits: int, unit: str) -> Column:
        return F.format_string(f"%.2f {unit}", F.bround(n / float(1 << bits), 2))

    return F.when(n >= 1 << 30, scaled(30, "GiB")).when(n >= 1 << 20, scaled(20, "MiB")).when(n >= 1 << 10, scaled(10, "KiB")).when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" B")))


def age_text(ts: Column, now: int) -> Column:
    """How long ago a time (seconds) was, in the largest whole unit up to days."""
    ago = F.lit(now) - ts

    def units(seconds: int, name: str) -> Column:
        n = F.floor(ago / seconds)
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    future = F.concat(F.lit("in the future? ts="), ts.cast("string"))
    return F.when(ago < 0, future).when(ago < 60, F.lit("just now")).when(ago < 3600, units(60, "minute")).when(ago < 86400, units(3600, "hour")).when(ago.isNotNull(), units(86400, "day"))


def largest_array(json: Column) -> Column:
    """{key, size} of the array field of a JSON object that is longest when written out, the smallest key of equals; null without any."""
    fields = F.map_entries(F.from_json(json, "map<string,variant>"))
    arrays = F.filter(fields, lambda e: F.schema_of_variant(e["value"]).startswith("ARRAY<"))
    sized = F.transform(arrays, lambda e: F.struct((-F.length(F.to_json(e["value"]))).alias("less"), e["key"].alias("key")))
    least = F.array_min(sized)
    return F.when(least.isNotNull(), F.struct(least["key"].alias("key"), (-least["less"]).alias("size")))


def _kept_items(items: Column, budget: Column) -> Column:
    """The first items whose written lengths add up to the budget at most; the first one always stays."""
    sizes = F.transform(items, lambda e: F.octet_length(F.to_json(e)).cast("bigint"))

    def step(so_far: Column, size: Column) -> Column:
        fits = so_far["open"] & ((so_far["used"] + size <= budget) | (so_far["n"] == 0))
        return F.struct((so_far["used"] + F.when(fits, size).otherwise(0)).alias("used"), (so_far["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    return F.slice(items, 1, F.aggregate(sizes, start, step)["n"])


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def capped(json: Column, kind: str, budget_tokens: int = BUDGET_CHARS // 4) -> Column:
    """A JSON response cut down to a budget of four characters a token; compact, keys in order.

    An object loses the end of its longest array field, an array its own end (and becomes ``results``); what is left fits beside the other fields, but
    one item stays. ``_meta`` says what was cut. Responses within the budget, and those without any array, stay whole; null and what is no JSON give null.
    """
    whole = F.to_json(F.try_parse_json(json))
    budget = F.lit(budget_tokens * 4).cast("bigint")
    quoted = lambda text: F.to_json(F.to_variant_object(F.array(text)))
    text_of = lambda text: F.substring(quoted(text), F.lit(2), F.length(quoted(text)) - 2)
    written = lambda items: F.concat(F.lit("["), F.array_join(F.transform(items, lambda e: F.to_json(e)), ","), F.lit("]"))

    def meta(items: Column, left: Column, hint: str, field: Column | None = None) -> Column:
        named = [] if field is None else [F.lit('"field":'), text_of(field), F.lit(",")]
        about = [F.lit(f'{{"approx_tokens_budget":{budget_tokens},'), *named, F.lit(f'"hint":"{hint}","kind":"{kind}","returned":'), F.size(left).cast("string"), F.lit(',"total_results":'), F.size(items).cast("string"), F.lit(',"truncated":true}')]
        return F.concat(*about)

    def cut_array(items: Column) -> Column:
        return _let(_kept_items(items, budget), lambda left: F.concat(F.lit('{"_meta":'), meta(items, left, CUT_LIST), F.lit(',"results":'), written(left), F.lit("}")))

    def cut_object(text: Column, longest: Column) -> Column:
        entries = F.array_sort(F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("text"))))
        items = F.from_json(F.element_at(F.filter(entries, lambda e: e["key"] == longest["key"]), 1)["text"], "array<variant>")
        left_of = lambda its: _kept_items(its, F.greatest(F.lit(0).cast("bigint"), budget - (F.octet_length(text) - longest["bytes"])))

        def rebuilt(its: Column, left: Column) -> Column:
            fields = F.filter(F.transform(entries, lambda e: F.when(e["key"] == longest["key"], F.struct(e["key"].alias("key"), written(left).alias("text"))).otherwise(e)), lambda e: e["key"] != "_meta")
            about = F.struct(F.lit("_meta").alias("key"), meta(its, left, CUT_OBJECT, longest["key"]).alias("text"))
            return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.concat(fields, F.array(about))), lambda e: F.concat(text_of(e["key"]), F.lit(":"), e["text"])), ","), F.lit("}"))

        return _let(items, lambda its: _let(left_of(its), lambda left: rebuilt(its, left)))

    def longest_of(text: Column) -> Column:
        fields = F.map_entries(F.from_json(text, "map<string,variant>"))
        arrays = F.filter(fields, lambda e: F.schema_of_variant(e["value"]).startswith("ARRAY<"))
        sized = F.transform(arrays, lambda e: F.struct((-F.octet_length(F.to_json(e["value"]))).alias("less"), e["key"].alias("key")))
        return _let(F.array_min(sized), lambda m: F.when(m.isNotNull(), F.struct(m["key"].alias("key"), (-m["less"]).alias("bytes"))))

    def cut(text: Column) -> Column:
        short = F.octet_length(text) <= budget
        as_object = _let(longest_of(text), lambda longest: F.when(longest.isNull(), text).otherwise(cut_object(text, longest)))
        return F.when(short, text).when(text.startswith("["), cut_array(F.from_json(text, "array<variant>"))).when(text.startswith("{"), as_object).otherwise(text)

    return _let(whole, cut)
