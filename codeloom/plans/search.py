"""Queries that answer from a persisted index: keyword ranking, the rare-literal gate, hybrid search, context bundles.

The index of a folder of tables is built by the first query that asks for it and lasts as long as the driver; it is built again when the tables
have changed. ``index_build`` builds one each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import inverted
from ..operators import retrieval as R
from ..sinks import index as X
from ..sinks.versions import Snapshot, Store
from .adapters import LINES_EACH, SYMBOL_FILES, SYMBOLS_SQL, refs, symbols, table
from .retrieve import _FIRST, _IN, _TOKENS, TERMS, _first

#: Names something literally (a quoted name), a symbol that texts hold (License) and one that they don't.
QUESTION = "where does `Apache_License` apply the License of f142, the MIT License?"
_known: dict[tuple[str, str], tuple[str, Snapshot]] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """What tells whether the tables that the index is made of are the same as before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in ("documents", "embeddings"):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        out += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in p.getFileSystem(conf).listStatus(p)]
    return "\n".join(out)


def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of the files that hold the symbols; every other one has a vector."""
    k = F.col("doc_id")
    start = (F.floor(k / SYMBOL_FILES) * LINES_EACH + 1).cast("int")
    d = table(spark, sf_dir, "documents").select(k.alias("chunk_id"), F.concat(F.lit("src/m"), (k % SYMBOL_FILES).cast("string"), F.lit(".rs")).alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"), start.alias("start_line"), (start + LINES_EACH - 2).alias("end_line"))
    return d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.sql("SELECT 'License' AS name, 'spdx::License' AS qualified_name, 'struct' AS kind, 'src/m3.rs' AS file_path, 1 AS line_start, 5 AS line_end")
    return symbols(spark, sf_dir).unionByName(named)


def built(spark: SparkSession, sf_dir: str) -> Snapshot:
    store = Store(spark, scratch.folder(spark, "search-index"))
    batch = store.begin()
    return batch.commit(**X.put_chunks(batch, search_chunks(spark, sf_dir), whole=True))


def search_index(spark: SparkSession, sf_dir: str) -> Snapshot:
    key, stamp = (spark.sparkContext.applicationId, sf_dir), _stamp(spark, sf_dir)
    if key not in _known or _known[key][0] != stamp:
        _known[key] = (stamp, built(spark, sf_dir))
    return _known[key][1]


def index_build(s, d):
    """Builds an index: blocks, postings, terms and words of its tables, from the blocks themselves."""
    snap = built(s, d)
    b = snap.table("postings")
    sums = b.agg(F.sum("n").alias("postings"), F.sum(F.expr("aggregate(postings, 0L, (a, p) -> a + p.tf)")).alias("words"), F.count_distinct("term").alias("terms"))
    return sums.withColumn("chunks", F.lit(snap.state["chunks"]).cast("bigint"))


def bm25_topk(s, d):
    return inverted.bm25(X.postings(search_index(s, d)), TERMS, 20).select("chunk_id", F.round("score", 5).alias("score"))


def token_df_gate(s, d):
    return inverted.document_frequency(X.postings(search_index(s, d)), TERMS)


def index_after_changes(s, d):
    """A copy of the index after two more batches, of which the first replaces and removes files, asked for ranks and frequencies."""
    store = Store(s, scratch.folder(s, "changed-index"))
    first = store.begin()
    chunks = search_chunks(s, d).drop("embedding")
    first.commit(**X.put_chunks(first, chunks, whole=True))
    number = F.regexp_extract("file_path", r"m(\d+)", 1).cast("int")
    for turn in (0, 1):
        batch = store.begin()
        # files m0, m10, .. get other texts, m1, m11, .. go; in the second turn m20, m40, .. change again
        here = chunks.withColumn("k", number).filter("k % 10 < 2" if turn == 0 else "k % 20 = 0")
        touched = batch.put("touched", here.select(F.col("file_path").alias("path"), (F.col("k") % 10 == 1).alias("gone")).distinct())
        new = here.filter("k % 10 = 0").withColumn("content", F.concat(F.lit("Apache license, " if turn == 0 else "the idiot "), F.coalesce("content", F.lit(""))))
        snap = batch.commit(**X.put_chunks(batch, new.drop("k"), whole=False, touched=touched))
    index = X.postings(snap)
    best = inverted.bm25(index, TERMS, 20).select(F.lit("rank").alias("what"), F.col("chunk_id").cast("string").alias("name"), F.round("score", 5).alias("value"))
    df = inverted.document_frequency(index, TERMS).select(F.lit("df").alias("what"), F.col("term").alias("name"), F.col("df").cast("double").alias("value"))
    return best.unionByName(df)


def _searched(s, d, **more):
    chunks = X.live(search_index(s, d), "chunks")
    return R.search(chunks, search_symbols(s, d), QUESTION, _first(s, d), index=X.postings(search_index(s, d)), **more)


def hybrid_search(s, d):
    """The question over all chunks, and over two languages, some files and from the fourth result on."""
    told = lambda x, asked: x.select(F.lit(asked).alias("asked"), "chunk_id", F.round("score", 6).alias("score"), F.coalesce(F.size("symbols"), F.lit(0)).cast("bigint").alias("symbols"))
    part = _searched(s, d, limit=8, offset=3, languages=["en", "de"], globs=["src/m[1-9]*.rs"])
    return told(_searched(s, d), "all").unionByName(told(part, "some"))


def context_of_query(s, d):
    chunks = X.live(search_index(s, d), "chunks")
    return R.context_of_query(_searched(s, d), refs(s, d), chunks, search_symbols(s, d))


def context_of_symbol(s, d):
    chunks = X.live(search_index(s, d), "chunks")
    parts = [R.context_of_symbol(name, refs(s, d), chunks, search_symbols(s, d)) for name in ("f42", "nowhere")]
    out = None
    for about, x in parts:
        x = x.withColumn("about", F.lit(about))
        out = x if out is None else out.unionByName(x)
    return out


QUERIES = {f.__name__: f for f in (index_build, bm25_topk, token_df_gate, index_after_changes, hybrid_search, context_of_query, context_of_symbol)}

_PART = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))"


def _ranked(texts: str, terms: str) -> str:
    """Common table expressions up to ``words`` (chunk_id, score): a full scan of a table (doc_id, text)."""
    return f"""tokens AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '') AS t FROM {texts}),
shape AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tokens),
hits AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tokens) WHERE term IN {terms} GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
words AS (SELECT chunk_id, sum({_PART}) AS score FROM hits JOIN df USING (term), shape GROUP BY 1)"""


_SYMBOLS = SYMBOLS_SQL.replace("FROM part\n", "FROM part UNION ALL SELECT 'License', 'spdx::License', 'struct', 'src/m3.rs', 1, 5\n", 1)
_SEARCH = f"""{_SYMBOLS},
chunk AS (SELECT doc_id AS chunk_id, 'src/m' || (doc_id % 200) || '.rs' AS file_path, lang AS language, coalesce(text, '') AS content, doc_id // 200 * 20 + 1 AS start_line, doc_id // 200 * 20 + 19 AS end_line,
  list_distance(CAST(embedding AS DOUBLE[]), CAST({_FIRST} AS DOUBLE[])) AS d FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
{_ranked("documents", "('apache_license', 'license', 'mit', 'f142')")}"""


def _results(name: str, limit: int, offset: int, where: str) -> str:
    wide = 3 * (limit + offset)
    return f"""{name}_sem AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) AS rk FROM chunk WHERE d IS NOT NULL AND {where}),
{name}_kw AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rk FROM words JOIN chunk USING (chunk_id) WHERE {where}),
{name}_fused AS (SELECT chunk_id, greatest(0, 1 - sum(p)) AS distance FROM (SELECT chunk_id, 1::DOUBLE / (60 + rk) AS p FROM {name}_sem WHERE rk <= {wide} UNION ALL SELECT chunk_id, 2::DOUBLE / (60 + rk) FROM {name}_kw WHERE rk <= {wide}) GROUP BY 1 ORDER BY distance, chunk_id LIMIT {wide}),
{name} AS (SELECT chunk_id, file_path, start_line, end_line, distance, 1 - distance * distance / 2 + 0.2 * CAST(contains(lower(content), 'license') AS INT) + 0.1 * CAST(contains(lower(content), 'f142') AS INT) AS score
  FROM {name}_fused JOIN chunk USING (chunk_id) ORDER BY score DESC, distance, chunk_id LIMIT {limit} OFFSET {offset})"""


_HELD = "(SELECT count(*) FROM symbols s WHERE s.file_path = x.file_path AND s.line_start <= x.end_line AND s.line_end >= x.start_line) AS symbols"
_SOME = "language IN ('en', 'de') AND regexp_matches(file_path, '^src/m[1-9][^/]*\\.rs$')"
_AROUND = "(SELECT c.chunk_id FROM chunk c WHERE c.file_path = l.file_path AND l.line BETWEEN c.start_line AND c.end_line ORDER BY c.start_line, c.chunk_id LIMIT 1)"
ORACLES = {
    "index_build": f"WITH {_TOKENS}, t AS (SELECT chunk_id, unnest(t) AS term FROM tokens) SELECT (SELECT count(*) FROM (SELECT DISTINCT chunk_id, term FROM t)) AS postings, count(*) AS words, count(DISTINCT term) AS terms, (SELECT count(*) FROM documents) AS chunks FROM t",
    "bm25_topk": f"WITH {_ranked('documents', _IN)} SELECT chunk_id, round(score, 5) AS score FROM words ORDER BY words.score DESC, chunk_id LIMIT 20",
    "token_df_gate": f"WITH {_TOKENS} SELECT term, count(*) AS df, (SELECT count(*) FROM documents) AS total FROM (SELECT unnest(list_distinct(t)) AS term FROM tokens) WHERE term IN {_IN} GROUP BY 1",
    "index_after_changes": f"""WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 200 % 20 = 0 THEN 'the idiot ' WHEN doc_id % 10 = 0 THEN 'Apache license, ' ELSE '' END || coalesce(text, '') AS text FROM documents WHERE doc_id % 200 % 10 <> 1), {_ranked("changed", _IN)}
SELECT * FROM (SELECT 'rank' AS what, CAST(chunk_id AS VARCHAR) AS name, round(score, 5) AS value FROM words ORDER BY words.score DESC, chunk_id LIMIT 20) UNION ALL SELECT 'df', term, CAST(df AS DOUBLE) FROM df""",
    "hybrid_search": f"""WITH {_SEARCH}, {_results("found", 10, 0, "true")}, {_results("part", 8, 3, _SOME)}
SELECT 'all' AS asked, chunk_id, round(score, 6) AS score, {_HELD} FROM found x UNION ALL SELECT 'some', chunk_id, round(score, 6), {_HELD} FROM part x""",
    "context_of_query": f"""WITH {_SEARCH}, {_results("found", 10, 0, "true")},
held AS (SELECT s.qualified_name, s.name, min((x.rk, s.line_start)) AS o FROM (SELECT *, row_number() OVER (ORDER BY score DESC, distance, chunk_id) AS rk FROM found) x JOIN symbols s ON s.file_path = x.file_path AND s.line_start <= x.end_line AND s.line_end >= x.start_line GROUP BY 1, 2),
defs AS (SELECT h.qualified_name AS held, h.name, h.o, min((s.file_path, s.line_start, s.qualified_name)) AS d FROM held h JOIN symbols s ON s.name = h.name GROUP BY ALL),
few AS (SELECT * FROM defs ORDER BY o, held LIMIT 5),
places AS (SELECT 'caller' AS role, from_file AS file_path, line FROM (SELECT from_file, line, row_number() OVER (PARTITION BY to_name_tail ORDER BY from_file, line) AS r FROM refs WHERE to_name_tail IN (SELECT name FROM few)) WHERE r <= 3 UNION ALL SELECT 'callee', d[1], d[2] FROM few)
SELECT 'primary' AS role, chunk_id, NULL AS name FROM found UNION ALL SELECT DISTINCT 'definition', NULL, d[3] FROM defs
UNION ALL SELECT DISTINCT role, chunk_id, NULL FROM (SELECT role, {_AROUND} AS chunk_id FROM places l) WHERE chunk_id NOT IN (SELECT chunk_id FROM found)""",
    "context_of_symbol": f"""WITH {_SEARCH}, defs AS (SELECT file_path, line_start AS line, qualified_name FROM symbols WHERE name = 'f42'),
prim AS (SELECT DISTINCT {_AROUND} AS chunk_id FROM defs l), places AS (SELECT from_file AS file_path, line FROM refs WHERE to_name_tail = 'f42' ORDER BY 1, 2 LIMIT 10)
SELECT 'symbol: f42' AS about, * FROM (SELECT 'primary' AS role, chunk_id, NULL AS name FROM prim WHERE chunk_id IS NOT NULL UNION ALL SELECT 'definition', NULL, qualified_name FROM defs
UNION ALL SELECT DISTINCT 'caller', chunk_id, NULL FROM (SELECT {_AROUND} AS chunk_id FROM places l) WHERE chunk_id NOT IN (SELECT chunk_id FROM prim WHERE chunk_id IS NOT NULL))""",
}
