"""Agent sessions: what tools were picked, what was read after an answer, and the listings and audits around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, requests


def reads_after(events: DataFrame, session: str, order: list[str], *, is_result: Column, is_read: Column, is_other_use: Column) -> DataFrame:
    """The results among the events, with ``reads``: how many reads follow before the next use of another tool.

    Uses of other tools cut a session into stretches; the reads that follow within the stretch count. Null conditions are false.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    so_far = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stretch = events.withColumn("_stretch", F.sum(flag(is_other_use)).over(so_far))
    later = Window.partitionBy(session, "_stretch").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    counted = stretch.withColumn("reads", F.coalesce(F.sum(flag(is_read)).over(later), F.lit(0)).cast("bigint")).withColumn("_result", flag(is_result))
    return counted.filter("_result = 1").drop("_stretch", "_result")


def selection_rates(calls: DataFrame, session: str, *, is_own: Column, is_grep: Column, pattern: Column) -> DataFrame:
    """One row: sessions, those that used the library's tools, and in those the own calls, the searches for identifiers and the share of own calls.

    Counts fold per session before they are added up, so a session of any length is a partial sum.
    """
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    per = calls.groupBy(session).agg(flag(is_own).alias("own"), flag(is_grep & requests.is_identifier_pattern(pattern)).alias("greps"))
    used = F.col("own") > 0
    total = lambda c: F.coalesce(F.sum(F.when(used, F.col(c))), F.lit(0))
    x = per.agg(F.count("*").alias("sessions"), F.count_if(used).alias("sessions_with_own"), total("own").alias("own_calls"), total("greps").alias("identifier_greps"))
    both = F.col("own_calls") + F.col("identifier_greps")
    return x.withColumn("rate", F.when(both > 0, F.col("own_calls") / both))


def subjects(asked: Column, answered: Column) -> Column:
    """What a call is about: the distinct names of its request and its response, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(asked, none), F.coalesce(answered, none)))


def eval_cases(messages: DataFrame, session: str, order: str, role: str, text: str, *, most: int | None = None) -> DataFrame:
    """(session, order, query, files): the searches that users typed, with the distinct files that their turn names, most files first.

    A turn is a user's message and what follows up to the next one; turns without files give no case. ``most`` keeps the first cases.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    so_far = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turns = messages.withColumn("_turn", F.sum((F.col(role) == "user").cast("int")).over(so_far))
    asked = turns.filter((F.col(role) == "user") & requests.is_search_query(t)).select(session, "_turn", order, t.alias("query"))
    named = turns.select(session, "_turn", F.explode(requests.mentioned_paths(t)).alias("file")).groupBy(session, "_turn").agg(F.array_sort(F.collect_set("file")).alias("files"))
    cases = asked.join(named, [session, "_turn"]).drop("_turn").orderBy(F.desc(F.size("files")), session, order)
    return cases if most is None else cases.limit(most)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with ``copies``; the audit of a table whose keys should be unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def keep_last(log: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each log, the others rotated out; the rank is cut before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def bundle_totals(chunks: DataFrame, by: list[str], order: str, path: str, content: str) -> DataFrame:
    """Of each bundle: chunks, bytes, about how many tokens, and its distinct files in the order in which they first appear."""
    per = chunks.groupBy(*by, path).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(content), F.lit(0))).alias("b"), F.min(order).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", path))), lambda x: x[path])
    return per.groupBy(*by).agg(F.sum("n").alias("chunks"), F.sum("b").alias("bytes"), F.floor(F.sum("b") / 4).alias("tokens"), listed.alias("files"))


def symbols_of_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The symbols of the files asked for, each with its place ``n`` in its file by line."""
    mine = symbols.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return mine.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("line_start", "line_end", "name")))


# fixed values: how the output of a failed call begins; calls, shares saved and a tool's share at which the verdict changes
FAILED_OUTPUT = r"^(?:MCP error|Error:|Exit code \d+)"
FEWEST_CALLS, WORTH_PERCENT, PROMOTE_PERCENT, ONE_TOOL_PERCENT = 20, 10.0, 25.0, 80.0


def usage_summary(calls: DataFrame, tool: str, size: str, rules: Sequence[str], *, text: str | None = None) -> DataFrame:
    """Per tool and in all (tool null): calls, bytes, errors, what each rule would save, and what the best rule of each call would save (``structured_best``).

    rules name columns with the size that a call's output would have under each rule. Errors are counted, but save nothing; a rule that makes an output longer saves nothing.
    """
    failed = F.coalesce(F.col(text).rlike(FAILED_OUTPUT), F.lit(False)) if text else F.lit(False)
    saved = lambda after: F.sum(F.when(failed, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col(size) - after)).cast("bigint"))
    best = F.least(*[F.col(r) for r in rules]) if len(rules) > 1 else F.col(rules[0])
    sums = [F.count("*").alias("calls"), F.sum(F.col(size).cast("bigint")).alias("bytes"), F.sum(failed.cast("bigint")).alias("errors"), *[saved(F.col(r)).alias(f"saved_{r}") for r in rules], saved(best).alias("structured_best")]
    x = calls.rollup(tool).agg(F.grouping(tool).alias("_all"), *sums)
    return x.select(F.when(F.col("_all") == 0, F.col(tool)).alias(tool), (F.col("_all") == 1).alias("is_total"), *[c for c in x.columns if c not in (tool, "_all")])


def usage_verdict(summary: DataFrame, tool: str) -> DataFrame:
    """One row: calls, bytes, the share that could be saved, the dearest tool with its share, and the verdict. summary: ``usage_summary``.

    inconclusive below 20 calls, not worth it below 10 % saved, marginal below 25 %, else promote; targeted where one tool has more than 80 % of all bytes.
    """
    total = summary.filter("is_total")
    # tools are few: one row of the greatest
    top = summary.filter("NOT is_total").agg(F.max(F.struct("bytes", tool)).alias("t"))
    x = total.join(top)
    share = F.when(F.col("bytes") > 0, 100.0 * F.col("structured_best") / F.col("bytes")).otherwise(0.0)
    top_share = F.when(F.col("bytes") > 0, 100.0 * F.col("t.bytes") / F.col("bytes")).otherwise(0.0)
    verdict = F.when(F.col("calls") < FEWEST_CALLS, "inconclusive").when(share < WORTH_PERCENT, "not worth it").when(share < PROMOTE_PERCENT, "marginal").otherwise("promote")
    return x.select("calls", "bytes", share.alias("saved_percent"), F.col(f"t.{tool}").alias("top_tool"), top_share.alias("top_percent"), verdict.alias("verdict"), (top_share > ONE_TOOL_PERCENT).alias("targeted"))


def harness_summary(tasks: DataFrame, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by``: tasks, shares of tasks whose first tool, or any tool, begins with prefix, and whose answer names an expected file; mean calls, cost and duration.

    tasks: tools (array, in order of use), answer, expected (array of paths), cost, duration. An expected path counts wherever it stands in the answer.
    """
    ours = lambda t: F.coalesce(t.startswith(prefix), F.lit(False))
    named = F.exists(F.coalesce("expected", F.array()), lambda p: (F.trim(p) != "") & F.contains(F.coalesce("answer", F.lit("")), p))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    tools = F.coalesce("tools", F.array())
    return tasks.groupBy(*by).agg(
        F.count("*").alias("tasks"), share(ours(F.get(tools, F.lit(0)))).alias("first"), share(F.exists(tools, ours)).alias("any"), share(named).alias("found"), F.avg(F.size(tools)).alias("mean_calls"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("duration"),
    )


def case_ids(cases: DataFrame, query: str, order: Sequence[str], prefix: str = "session-") -> DataFrame:
    """cases with ``case_id``: the prefix and a slug of the query; later cases of the same slug get -2, -3, ... in the order given."""
    slug = names.slugify(F.coalesce(F.col(query), F.lit("")))
    slug = F.when(slug == "", F.lit("case")).otherwise(slug)
    rank = F.row_number().over(Window.partitionBy("_slug").orderBy(*order))
    x = cases.withColumn("_slug", slug).withColumn("_n", rank)
    return x.withColumn("case_id", F.concat(F.lit(prefix), F.col("_slug"), F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(F.lit("")))).drop("_slug", "_n")


def corpus_lines(cases: DataFrame, query: str, files: str) -> DataFrame:
    """(case_id, text): each case as an entry of a YAML list, the query quoted; cases have case_id and an array of expected files."""
    said = F.trim(F.regexp_replace(F.col(query), "\n", " "))
    quoted = F.replace(F.replace(said, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    listed = F.array_join(F.transform(F.col(files), lambda f: F.concat(F.lit("      - "), f)), "\n")
    parts = [F.concat(F.lit("  - id: "), F.col("case_id")), F.lit("    source: session"), F.concat(F.lit('    query: "'), quoted, F.lit('"')), F.lit("    expected_files:"), listed]
    return cases.select("case_id", F.concat_ws("\n", *parts).alias("text"))
