"""The driver's tables in the shapes of the canonical ones, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history

#: 2001-08-02, the day after the last order.
NOW = 996710400
SYMBOL_FILES, LINES_EACH = 200, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.col("o_orderpriority")
    subject = F.when(kind == "1-URGENT", "fix: order").when(kind == "5-LOW", "chore: order").when(kind == "4-NOT SPECIFIED", "chore: migrate order").otherwise("feat: order")
    return o.select(F.col("o_orderkey").alias("commit_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), subject.alias("subject"))


def path_of(k):
    """Of a number: tests, vendored files, settings, and sources of two languages, in ten directories."""
    d, n = (k % 10).cast("string"), k.cast("string")
    made = lambda before, after: F.concat(F.lit(before + "/d"), d, F.lit("/f"), n, F.lit(after))
    return (
        F.when(k % 7 == 0, made("tests", "_test.rs"))
        .when(k % 11 == 0, made("vendor", ".rs"))
        .when(k % 13 == 0, made("conf", ".toml"))
        .when(k % 5 == 0, made("src", ".py"))
        .otherwise(made("src", ".rs"))
    )


def file_changes(spark: SparkSession, sf_dir: str, key: str = "l_partkey") -> DataFrame:
    # a commit's lines stand together from the start, so that neither this fold nor that of the changes which count is shuffled anew
    li = history.by_commit(table(spark, sf_dir, "lineitem"), "l_orderkey")
    x = li.groupBy("l_orderkey", key).agg(F.sum("l_quantity").cast("bigint").alias("added"), F.sum("l_linenumber").cast("bigint").alias("deleted"))
    return x.select(F.col("l_orderkey").alias("commit_id"), path_of(F.col(key)).alias("path"), "added", "deleted")


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One function a supplier, in the file whose history ``file_changes`` by l_suppkey tells."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("f"), k.cast("string"))
    return table(spark, sf_dir, "supplier").select(name.alias("name"), F.concat(F.lit("m::"), name).alias("qualified_name"), F.lit("function").alias("kind"), path_of(k).alias("file_path"), F.lit(1).alias("line_start"), F.lit(10).alias("line_end"))


def code_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function calls that of a third of its number; some import the next one in a ring of six."""
    k = F.col("s_suppkey")
    ring = F.when(k % 60 < 12, k - k % 6 + (k % 6 + 1) % 6)
    named = lambda n, kind, line: F.struct(F.concat(F.lit("f"), n.cast("string")).alias("to_name"), F.lit(kind).alias("kind"), F.lit(line).alias("line"))
    x = table(spark, sf_dir, "supplier").select(path_of(k).alias("from_file"), F.explode(F.array(named(F.floor(k / 3), "call", 5), named(ring, "import", 6))).alias("r"))
    return x.filter("r.to_name is not null").select("from_file", "r.to_name", F.col("r.to_name").alias("to_name_tail"), "r.kind", "r.line")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    start = (F.floor(k / SYMBOL_FILES) * LINES_EACH + 1).cast("int")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("f"), k.cast("string")).alias("name"),
        F.concat("p_brand", F.lit("."), F.lit("f"), k.cast("string")).alias("qualified_name"),
        F.when(F.col("p_size") > 25, F.lit("function")).otherwise(F.lit("method")).alias("kind"),
        F.concat(F.lit("src/m"), (k % SYMBOL_FILES).cast("string"), F.lit(".rs")).alias("file_path"),
        start.alias("line_start"),
        (start + LINES_EACH - 2).alias("line_end"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and imports of parts by name, on lines of the symbols beside them; every seventh line of an order includes a file by its path."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    file = F.concat(F.lit("m"), (k % SYMBOL_FILES).cast("string"), F.lit(".rs"))
    tail = F.when(F.col("l_linenumber") == 7, file).otherwise(F.concat(F.lit("f"), k.cast("string")))
    return li.select(
        F.concat(F.lit("src/m"), (F.col("l_suppkey") % SYMBOL_FILES).cast("string"), F.lit(".rs")).alias("from_file"),
        F.concat(F.when(F.col("l_linenumber") == 7, F.lit("src/")).otherwise(F.lit("pkg::")), tail).alias("to_name"),
        tail.alias("to_name_tail"),
        F.when(F.col("l_linenumber") == 7, F.lit("include")).when(F.col("l_linenumber") % 2 == 0, F.lit("import")).otherwise(F.lit("call")).alias("kind"),
        (F.floor(k / SYMBOL_FILES) * LINES_EACH + F.col("l_linenumber")).cast("int").alias("line"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as numbered lines of three logs: a header a commit, and a line a file, some of them renamed or binary."""
    log = lambda key: F.concat(F.lit("log"), (F.col(key) % 3).cast("string")).alias("log_id")
    c = commits(spark, sf_dir)
    heads = c.select(log("commit_id"), (F.col("commit_id") * 8).alias("line_no"), F.concat_ws("\t", F.lit("commit"), F.col("commit_id").cast("string"), F.when(F.col("commit_id") % 50 == 7, F.lit("bad")).otherwise(F.col("ts").cast("string")), "subject").alias("line"))
    k = F.col("l_partkey").cast("string")
    path = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("src/{old => new}/f"), k, F.lit(".rs"))).otherwise(F.concat(F.lit("src/f"), k, F.lit(".rs")))
    added = F.when(F.col("l_partkey") % 9 == 0, F.lit("-")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    li = table(spark, sf_dir, "lineitem")
    return heads.unionByName(li.select(log("l_orderkey"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), F.concat_ws("\t", added, F.col("l_linenumber").cast("string"), path).alias("line")))


def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of thirty files each, as many as the customers ask for, and one-way edges from a ring to the next, but for every tenth."""
    k = F.col("o_custkey").cast("int")
    ring = (k - k % 30) + (k % 30 + 1 + (F.col("o_orderkey") % 5).cast("int")) % 30
    to = F.when((F.col("o_orderstatus") == "P") & (k % 300 < 270), k + 30).otherwise(ring)
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("n"), k.cast("string")).alias("src"), F.concat(F.lit("n"), to.cast("string")).alias("dst"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("l"), F.col("label").cast("string")).alias("language"), F.concat(F.lit("d"), (F.col("vec_id") % 5).cast("string"), F.lit("/v.rs")).alias("file_path"))


_PATH_SQL = """CASE WHEN k % 7 = 0 THEN 'tests/d' || (k % 10) || '/f' || k || '_test.rs' WHEN k % 11 = 0 THEN 'vendor/d' || (k % 10) || '/f' || k || '.rs'
      WHEN k % 13 = 0 THEN 'conf/d' || (k % 10) || '/f' || k || '.toml' WHEN k % 5 = 0 THEN 'src/d' || (k % 10) || '/f' || k || '.py' ELSE 'src/d' || (k % 10) || '/f' || k || '.rs' END"""


def history_sql(key: str) -> str:
    """The history tables as common table expressions, of files numbered by a column of lineitem; with the library's own guard and minimum."""
    return f"""
commits AS (
  SELECT o_orderkey AS commit_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 'fix: order'
    WHEN '5-LOW' THEN 'chore: order' WHEN '4-NOT SPECIFIED' THEN 'chore: migrate order' ELSE 'feat: order' END AS subject FROM orders
), changes AS (
  SELECT l_orderkey AS commit_id, k, {_PATH_SQL} AS path, k % 7 = 0 AS test, added, deleted
  FROM (SELECT l_orderkey, {key} AS k, CAST(sum(l_quantity) AS BIGINT) AS added, CAST(sum(l_linenumber) AS BIGINT) AS deleted FROM lineitem GROUP BY 1, 2)
), kept AS (
  SELECT c.commit_id, c.ts, starts_with(c.subject, 'fix:') AS is_fix, k, path, test, added, deleted,
    exp(-greatest({NOW} - c.ts, 0) / 86400.0 / 180.0) AS decay
  FROM changes JOIN commits c ON c.commit_id = changes.commit_id
  WHERE NOT (starts_with(c.subject, 'chore:') AND NOT contains(c.subject, 'migrate')) AND NOT starts_with(path, 'vendor/')
), history AS (
  SELECT path, any_value(k) AS k, sum(decay * least((added + deleted) / 100.0, 3.0)) AS churn_score, CAST(count(*) FILTER (WHERE is_fix) AS BIGINT) AS fix_count,
    count(*) AS total_commits, max(ts) AS last_commit_at FROM kept GROUP BY path
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY commit_id) AS n FROM kept
), pairs AS (
  SELECT a.path AS file_a, b.path AS file_b, sum(a.decay) AS weight, count(*) AS n, max(a.ts) AS last_observed_at
  FROM sized a JOIN sized b ON a.commit_id = b.commit_id AND a.path < b.path WHERE a.n <= 30 AND NOT (a.test AND b.test)
  GROUP BY 1, 2 HAVING count(*) >= 3
), sides AS (
  SELECT file_a AS path, file_b AS file, weight, n, last_observed_at FROM pairs UNION ALL SELECT file_b, file_a, weight, n, last_observed_at FROM pairs
), percentile AS (
  SELECT path, k, churn_score, fix_count, total_commits, last_commit_at, cume_dist() OVER (ORDER BY churn_score) AS churn_percentile FROM history
), top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(weight, 9) DESC, file) AS rk FROM sides) WHERE rk <= 20
), coupled AS (
  SELECT path, count(*) AS coupled_files, bool_or(regexp_matches(file, '(^|/)tests/')) AS coupled_test FROM top WHERE rk <= 10 GROUP BY path
), code AS (
  SELECT s_suppkey AS k, {_PATH_SQL} AS path FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)
), uses AS (
  SELECT a, b FROM (SELECT k AS a, k // 3 AS b FROM code UNION SELECT k, k - k % 6 + (k % 6 + 1) % 6 FROM code WHERE k % 60 < 12) WHERE b IN (SELECT k FROM code)
), reached AS (
  SELECT b AS k, a AS src FROM uses WHERE a <> b UNION SELECT x.b, y.a FROM uses x JOIN uses y ON y.b = x.a WHERE x.a <> x.b AND y.a <> x.b
), dependents AS (
  SELECT k, CAST(count(*) AS INTEGER) AS dependent_files FROM reached WHERE src % 7 <> 0 AND (src % 11 = 0 OR src % 13 <> 0) GROUP BY 1
), assessed AS (
  SELECT p.path, p.k, p.churn_score, p.churn_percentile, p.fix_count / p.total_commits AS fix_ratio, p.total_commits, p.fix_count, coalesce(coupled_files, 0) AS coupled_files,
    coalesce(dependent_files, 0) AS dependent_files,
    NOT (coalesce(coupled_test, false) OR (p.path LIKE 'src/%.rs' AND EXISTS (SELECT 1 FROM history WHERE starts_with(path, 'tests/')))) AS test_gap
  FROM percentile p LEFT JOIN coupled USING (path) LEFT JOIN dependents d ON d.k = p.k
), scored AS (
  SELECT *, 0.35 * churn_percentile + 0.20 * fix_ratio + 0.15 * least(dependent_files / 20.0, 1.0) + 0.15 * least(coupled_files / 10.0, 1.0) + 0.15 * CAST(test_gap AS DOUBLE) AS score FROM assessed
)"""


SYMBOLS_SQL = """
symbols AS (
  SELECT 'f' || p_partkey AS name, p_brand || '.f' || p_partkey AS qualified_name, CASE WHEN p_size > 25 THEN 'function' ELSE 'method' END AS kind,
    'src/m' || (p_partkey % 200) || '.rs' AS file_path, CAST(p_partkey // 200 * 20 + 1 AS INTEGER) AS line_start, CAST(p_partkey // 200 * 20 + 19 AS INTEGER) AS line_end FROM part
), refs AS (
  SELECT 'src/m' || (l_suppkey % 200) || '.rs' AS from_file, CASE WHEN l_linenumber = 7 THEN 'src/m' || (l_partkey % 200) || '.rs' ELSE 'pkg::f' || l_partkey END AS to_name,
    CASE WHEN l_linenumber = 7 THEN 'm' || (l_partkey % 200) || '.rs' ELSE 'f' || l_partkey END AS to_name_tail,
    CASE WHEN l_linenumber = 7 THEN 'include' WHEN l_linenumber % 2 = 0 THEN 'import' ELSE 'call' END AS kind, CAST(l_partkey // 200 * 20 + l_linenumber AS INTEGER) AS line
  FROM lineitem
)"""

IMPORTS_SQL = """
edges AS (
  SELECT DISTINCT 'n' || k AS src, 'n' || CASE WHEN o_orderstatus = 'P' AND k % 300 < 270 THEN k + 30 ELSE (k - k % 30) + (k % 30 + 1 + o_orderkey % 5) % 30 END AS dst
  FROM (SELECT *, o_custkey AS k FROM orders)
)"""
