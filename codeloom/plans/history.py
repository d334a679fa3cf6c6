"""Queries over version-control history. Files are parts where many files matter, and suppliers where pairs do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import names, paths
from ..operators import graph as G
from ..operators import history as H
from ..operators import structural as S
from ..sources import gitlog, ignore
from .adapters import NOW, code_refs, code_symbols, commits, file_changes, history_sql, log_lines

PATCH = r"^src/d[1-5]/"


def _kept(s, d, key: str = "l_partkey") -> DataFrame:
    return H.kept_changes(commits(s, d), file_changes(s, d, key))


def _indexed(s, d, key: str = "l_suppkey") -> H.Indexed:
    return H.index_history(commits(s, d), file_changes(s, d, key), NOW)


def soft_skip_filter(s, d):
    c = commits(s, d)
    return c.groupBy(names.is_skipped(F.col("subject")).alias("skipped"), names.is_fix(F.col("subject")).alias("is_fix")).agg(F.count("*").alias("n"))


def file_churn(s, d):
    return H.file_history(_kept(s, d), NOW).withColumn("churn_score", F.round("churn_score", 6))


def co_change_pairs(s, d):
    x = H.co_changes(_kept(s, d, "l_suppkey"), NOW)
    return x.select("file_a", "file_b", F.round("weight", 6).alias("weight"), F.col("count").alias("n"), "last_observed_at")


def co_change_topn(s, d):
    x = H.top_coupled(_indexed(s, d).pairs(), 3)
    return x.select("path", "file", F.round("weight", 6).alias("weight"), F.col("count").alias("n"), F.col("rank").cast("bigint").alias("rk"))


def churn_percentile(s, d):
    return H.churn_percentile(H.file_history(_kept(s, d), NOW)).select("path", F.round("churn_percentile", 6).alias("churn_percentile"))


def fix_ratio(s, d):
    x = H.file_history(_kept(s, d), NOW)
    return x.select("path", F.round(F.col("fix_count") / F.col("total_commits"), 6).alias("fix_ratio"))


def _assessed(s, d, patch: str | None = None):
    ix = _indexed(s, d)
    asked = ix.history.select("path")
    asked = asked.filter(F.col("path").rlike(patch)) if patch else asked
    reach = G.dependents(code_symbols(s, d), code_refs(s, d), asked)
    return H.assess_risk(asked, ix.history, ix.pairs(), reach), asked, ix


def risk_score(s, d):
    x = _assessed(s, d)[0]
    told = F.array_join("notes", "|").alias("notes")
    return x.select("path", F.round("score", 6).alias("score"), F.round("fix_ratio", 6).alias("fix_ratio"), "total_commits", "fix_count", "coupled_files", "dependent_files", "test_gap", told)


_LISTS = ("test_gap_files", "hotspot_files", "fix_heavy_files", "wide_blast_files")


def risk_rollup(s, d):
    r = H.risk_rollup(_assessed(s, d)[0])
    lists = [F.array_join(c, ",").alias(c) for c in _LISTS]
    return r.select("files", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 6).alias("mean_score"), "max_risk_file", *lists)


def risk_diff(s, d):
    """The report on a patch: rollup, import cycles that it touches, and notes."""
    x, asked, ix = _assessed(s, d, PATCH)
    cycles = G.cycles_touching(G.components(S.import_edges(code_refs(s, d), code_symbols(s, d))), asked, ix.history)
    r = H.risk_of_patch(x, cycles)
    return r.select("files", F.round("max_score", 6).alias("max_score"), "max_risk_file", "cycles", "largest_cycle", F.array_join("notes", "|").alias("notes"))


def cycles_of_patch(s, d):
    ix = _indexed(s, d)
    asked = ix.history.select("path").filter(F.col("path").rlike(PATCH))
    c = G.cycles_touching(G.components(S.import_edges(code_refs(s, d), code_symbols(s, d))), asked, ix.history)
    return c.select("component", "size", F.array_join("members", ",").alias("members"), "max_churn_file")


def dir_cluster(s, d):
    x = H.cluster_by_directory(_assessed(s, d)[0])
    top = F.array_join(F.transform("top", lambda t: t["path"]), ",").alias("top")
    return x.select("dir", "files", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 6).alias("mean_score"), "omitted", top)


def shown_files(s, d):
    return H.shown_files(_assessed(s, d)[0]).select("dir", "path", F.round("score", 6).alias("score"))


def coupled_tests(s, d):
    ix = _indexed(s, d)
    asked = ix.history.select("path").filter(F.col("path").endswith(".py"))
    return H.recommend_tests(asked, ix.history, ix.pairs()).select("test", "kind", F.round("weight", 6).alias("weight"))


def primary_tests(s, d):
    ix = _indexed(s, d, "l_partkey")
    return H.recommend_tests(ix.history.select("path"), ix.history, ix.pairs()).select("test", "kind")


def recommended_tests(s, d):
    """Tests for all sources, where those of one directory are known by their co-changes only: most coupled tests are primary ones already."""
    ix = _indexed(s, d)
    known = ix.history.filter(~F.col("path").startswith("tests/d7/"))
    asked = ix.history.select("path").filter(F.col("path").startswith("src/"))
    return H.recommend_tests(asked, known, ix.pairs()).select("test", "kind", F.round("weight", 6).alias("weight"))


def coupling_report(s, d):
    ix = _indexed(s, d, "l_partkey")
    r = H.coupling_report(ix.history.select("path"), ix.history, ix.pairs())
    return r.select("path", F.coalesce(F.size("coupled"), F.lit(0)).cast("bigint").alias("n_coupled"), F.array_join(F.transform("coupled", lambda t: t["file"]), ",").alias("files"), "file_commits", F.coalesce("note", F.lit("")).alias("note"))


def incremental_equals_batch(s, d):
    """The history of two halves merged, which equals that of the whole."""
    kept = _kept(s, d)
    early = H.file_history(kept.filter("commit_id % 2 = 0"), NOW)
    late = H.file_history(kept.filter("commit_id % 2 = 1"), NOW)
    return H.merge_history(early, late).withColumn("churn_score", F.round("churn_score", 6))


def incremental_pairs(s, d):
    """The pair facts of two halves merged, which equal those of the whole."""
    kept = scratch.written(_kept(s, d, "l_suppkey"), "kept")
    x = H.merge_pairs(H.pair_facts(kept.filter("commit_id % 2 = 0"), NOW), H.pair_facts(kept.filter("commit_id % 2 = 1"), NOW)).filter("count >= 3")
    return x.select("file_a", "file_b", F.round("weight", 6).alias("weight"), F.col("count").alias("n"), "last_observed_at")


def gated_pairs(s, d):
    """Of a batch's pairs those that update a stored table: known ones, and new ones that reach the minimum alone."""
    kept = _kept(s, d)
    stored, batch = H.co_changes(kept.filter("commit_id % 4 <> 0"), NOW, min_count=2), H.pair_facts(kept.filter("commit_id % 4 = 0"), NOW)
    return H.gated_pairs(stored, batch, 2).select("file_a", "file_b", F.col("count").alias("n"))


def history_stats(s, d):
    kept = scratch.written(_kept(s, d, "l_suppkey"), "kept")
    return H.history_stats(kept, H.file_history(kept, NOW), H.co_changes(kept, NOW))


def decayed_later(s, d):
    """Scores as of thirty days later: scaled, which equals folding with a later now."""
    return H.scale_decay(H.file_history(_kept(s, d), NOW), "churn_score", 30 * 86400).select("path", F.round("churn_score", 6).alias("churn_score"))


def file_category(s, d):
    x = file_changes(s, d).select("path").distinct()
    return x.select("path", paths.file_category(F.col("path")).alias("category"), paths.is_test_like(F.col("path")).alias("test_like"), paths.is_excluded(F.col("path")).alias("excluded"), paths.language_of(F.col("path")).alias("language"))


def glob_filter(s, d):
    x = file_changes(s, d).select("path").distinct()
    return x.filter(paths.any_glob(F.col("path"), ["src/d[1-3]/*7*.rs", "**/d4/**", "**/*9.py"]))


def log_parse(s, d):
    """The changes that three logs tell, and their commits, parsed from numbered lines."""
    c, changes = gitlog.parse(s, log_lines(s, d))
    heads = c.select("log_id", "commit_id", F.col("subject").alias("name"), "ts", F.lit(None).cast("bigint").alias("added"))
    return heads.unionByName(changes.select("log_id", "commit_id", F.col("path").alias("name"), F.lit(None).cast("bigint").alias("ts"), "added"))


#: Rules files by directory.
RULES = {"": "vendor/\n*.toml\n!conf/d3/*.toml\n/tests/d[0-4]/\n!tests/d1/f7*", "src/d1": "*.py\n!f1*.py", "src/d2": "*", "src": "!d2/f*2.rs\n**/f?.rs\nd4/**\n!d4/f4*"}


def ignored_paths(s, d):
    x = file_changes(s, d).select(F.lit("p").alias("project"), "path").distinct()
    files = s.createDataFrame([("p", k, v.encode()) for k, v in RULES.items()], "project string, directory string, content binary")
    return ignore.kept(x, ignore.rules_of(files)).select("path")


def _sql(body: str, key: str = "l_partkey") -> str:
    return f"WITH {history_sql(key)} {body}"


QUERIES = {f.__name__: f for f in (
    soft_skip_filter, file_churn, co_change_pairs, co_change_topn, churn_percentile, fix_ratio, risk_score, risk_rollup, risk_diff, cycles_of_patch, dir_cluster, shown_files, coupled_tests,
    primary_tests, recommended_tests, coupling_report, incremental_equals_batch, incremental_pairs, gated_pairs, history_stats, decayed_later, file_category, glob_filter, log_parse, ignored_paths,
)}

_S = "l_suppkey"
_LIST = "coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE {}), '')"
_HOT, _FIXED, _WIDE = "churn_percentile >= 0.75", "fix_ratio >= 0.4 AND total_commits >= 5", "dependent_files >= 10"
_PATCHED = "patch AS (SELECT * FROM scored WHERE regexp_matches(path, '^src/d[1-5]/'))"
_RINGS = """ring AS (SELECT k - k % 6 AS r, count(*) AS n FROM code WHERE k % 60 < 12 GROUP BY 1 HAVING count(*) = 6),
member AS (SELECT r, n, code.path, churn_score FROM code JOIN ring ON r = k - k % 6 AND k % 60 < 12 LEFT JOIN history USING (path)),
touched AS (SELECT r, min(path) AS component, CAST(any_value(n) AS INTEGER) AS size, string_agg(path, ',' ORDER BY path) AS members, arg_max(path, churn_score) AS max_churn_file
  FROM member GROUP BY r HAVING bool_or(path IN (SELECT path FROM patch)))"""
ORACLES = {
    "soft_skip_filter": _sql("SELECT starts_with(subject, 'chore:') AND NOT contains(subject, 'migrate') AS skipped, starts_with(subject, 'fix:') AS is_fix, count(*) AS n FROM commits GROUP BY 1, 2"),
    "file_churn": _sql("SELECT path, round(churn_score, 6) AS churn_score, fix_count, total_commits, last_commit_at FROM history"),
    "co_change_pairs": _sql("SELECT file_a, file_b, round(weight, 6) AS weight, n, last_observed_at FROM pairs", _S),
    "co_change_topn": _sql("SELECT path, file, round(weight, 6) AS weight, n, rk FROM top WHERE rk <= 3", _S),
    "churn_percentile": _sql("SELECT path, round(churn_percentile, 6) AS churn_percentile FROM percentile"),
    "fix_ratio": _sql("SELECT path, round(fix_count / total_commits, 6) AS fix_ratio FROM history"),
    "risk_score": _sql(f"""SELECT path, round(score, 6) AS score, round(fix_ratio, 6) AS fix_ratio, total_commits, fix_count, coupled_files, dependent_files, test_gap,
  concat_ws('|', CASE WHEN {_HOT} THEN 'hotspot' END, CASE WHEN {_FIXED} THEN 'fix-heavy' END, CASE WHEN {_WIDE} THEN 'wide blast radius' END, CASE WHEN coupled_files >= 5 THEN 'high coupling' END, CASE WHEN test_gap THEN 'test gap' END) AS notes FROM scored""", _S),
    "risk_rollup": _sql(f"""SELECT count(*) AS files, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, arg_max(path, (round(score, 9), path)) AS max_risk_file,
  {_LIST.format("test_gap")} AS test_gap_files, {_LIST.format(_HOT)} AS hotspot_files, {_LIST.format(_FIXED)} AS fix_heavy_files, {_LIST.format(_WIDE)} AS wide_blast_files FROM scored""", _S),
    "risk_diff": _sql(f""", {_PATCHED}, {_RINGS}, n AS (SELECT count(*) AS files, max(score) AS top, arg_max(path, (round(score, 9), path)) AS max_risk_file, count(*) FILTER (WHERE {_HOT}) AS hot,
  count(*) FILTER (WHERE {_FIXED}) AS fixed, count(*) FILTER (WHERE test_gap) AS gap, count(*) FILTER (WHERE {_WIDE}) AS wide FROM patch), c AS (SELECT count(*) AS cycles, coalesce(max(size), 0) AS largest_cycle FROM touched)
SELECT files, round(coalesce(top, 0), 6) AS max_score, max_risk_file, cycles, largest_cycle, concat_ws('|', CASE WHEN hot > 0 THEN hot || ' hotspot file(s)' END, CASE WHEN fixed > 0 THEN fixed || ' fix-heavy file(s)' END,
  CASE WHEN gap > 0 THEN gap || ' file(s) without a test' END, CASE WHEN wide > 0 THEN wide || ' file(s) with a wide blast radius' END, CASE WHEN top >= 0.6 THEN printf('highest risk %.2f', top) END,
  CASE WHEN cycles > 0 THEN cycles || ' import cycle(s), the largest of ' || largest_cycle || ' files' END) AS notes FROM n, c""", _S),
    "cycles_of_patch": _sql(f", {_PATCHED}, {_RINGS} SELECT component, size, members, max_churn_file FROM touched", _S),
    "dir_cluster": _sql("SELECT dir, count(*) AS files, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, count(*) - least(count(*), 3) AS omitted, string_agg(path, ',' ORDER BY r) FILTER (WHERE r <= 3) AS top FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY round(score, 9) DESC, path) AS r FROM scored) GROUP BY 1 HAVING count(*) >= 5", _S),
    "shown_files": _sql("SELECT dir, path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY round(score, 9) DESC, path) AS r, count(*) OVER (PARTITION BY dir) AS n FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM scored)) WHERE n < 5 OR r <= 3", _S),
    "coupled_tests": _sql("SELECT file AS test, 'coupled' AS kind, round(max(weight), 6) AS weight FROM top WHERE path LIKE '%.py' AND starts_with(file, 'tests/') GROUP BY 1", _S),
    "primary_tests": _sql("SELECT path AS test, 'primary' AS kind FROM history WHERE starts_with(path, 'tests/')"),
    "recommended_tests": _sql("""SELECT path AS test, 'primary' AS kind, NULL::DOUBLE AS weight FROM history WHERE starts_with(path, 'tests/') AND NOT starts_with(path, 'tests/d7/')
UNION ALL SELECT file, 'coupled', round(max(weight), 6) FROM top WHERE starts_with(path, 'src/') AND starts_with(file, 'tests/') AND file NOT IN (SELECT path FROM history WHERE starts_with(path, 'tests/') AND NOT starts_with(path, 'tests/d7/')) GROUP BY 1""", _S),
    "coupling_report": _sql("""SELECT h.path, coalesce(n, 0) AS n_coupled, files, h.total_commits AS file_commits,
  CASE WHEN n IS NOT NULL THEN '' WHEN h.total_commits < 3 THEN 'only ' || h.total_commits || ' commit(s) are known; a pair needs 3' ELSE h.total_commits || ' commits, but no pair reaches 3; the file changes alone' END AS note
FROM history h LEFT JOIN (SELECT path, count(*) AS n, string_agg(file, ',' ORDER BY rk) AS files FROM top WHERE rk <= 10 GROUP BY 1) c ON c.path = h.path"""),
    "incremental_equals_batch": _sql("SELECT path, round(churn_score, 6) AS churn_score, fix_count, total_commits, last_commit_at FROM history"),
    "incremental_pairs": _sql("SELECT file_a, file_b, round(weight, 6) AS weight, n, last_observed_at FROM pairs", _S),
    "gated_pairs": _sql(""", both_parts AS (SELECT a.path AS file_a, b.path AS file_b, count(*) FILTER (WHERE a.commit_id % 4 <> 0) AS old, count(*) FILTER (WHERE a.commit_id % 4 = 0) AS n
  FROM sized a JOIN sized b ON a.commit_id = b.commit_id AND a.path < b.path WHERE a.n <= 30 AND NOT (a.test AND b.test) GROUP BY 1, 2)
SELECT file_a, file_b, n FROM both_parts WHERE n > 0 AND (old >= 2 OR n >= 2)"""),
    "history_stats": _sql("SELECT (SELECT count(DISTINCT commit_id) FROM kept) AS commits, (SELECT count(*) FROM history) AS files, (SELECT count(*) FROM pairs) AS pairs", _S),
    "decayed_later": _sql("SELECT path, round(churn_score * exp(-30.0 / 180.0), 6) AS churn_score FROM history"),
    "file_category": _sql("SELECT DISTINCT path, CASE WHEN test THEN 'test' WHEN path LIKE '%.toml' THEN 'config' ELSE 'source' END AS category, test AS test_like, test OR starts_with(path, 'vendor/') AS excluded, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.rs' THEN 'rust' END AS language FROM changes"),
    "glob_filter": _sql("SELECT DISTINCT path FROM changes WHERE regexp_matches(path, '^src/d[1-3]/.*7.*\\.rs$') OR contains(path, '/d4/') OR path LIKE '%9.py'"),
    "log_parse": """WITH c AS (SELECT 'log' || (o_orderkey % 3) AS log_id, CAST(o_orderkey AS VARCHAR) AS commit_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 'fix: order'
    WHEN '5-LOW' THEN 'chore: order' WHEN '4-NOT SPECIFIED' THEN 'chore: migrate order' ELSE 'feat: order' END AS subject FROM orders WHERE o_orderkey % 50 <> 7)
SELECT log_id, commit_id, subject AS name, ts, NULL AS added FROM c UNION ALL
SELECT log_id, commit_id, 'src/' || CASE WHEN l_partkey % 4 = 0 THEN 'new/f' ELSE 'f' END || l_partkey || '.rs', NULL, CAST(l_quantity AS BIGINT) FROM lineitem JOIN c ON commit_id = CAST(l_orderkey AS VARCHAR) WHERE l_partkey % 9 <> 0""",
    "ignored_paths": _sql(r"""SELECT DISTINCT path FROM changes WHERE NOT starts_with(path, 'vendor/') AND NOT regexp_matches(path, '^conf/(d[^3]|d3.*/.*/).*\.toml$') AND NOT regexp_matches(path, '^tests/d[0-4]/')
AND NOT (regexp_matches(path, '^src/d1/[^/]*\.py$') AND NOT regexp_matches(path, '^src/d1/f1[^/]*\.py$')) AND NOT starts_with(path, 'src/d2/') AND NOT (regexp_matches(path, '^src/(.*/)?f[^/]\.rs$') AND NOT starts_with(path, 'src/d4/'))
AND NOT (starts_with(path, 'src/d4/') AND NOT regexp_matches(path, '^src/d4/f4'))"""),
}
