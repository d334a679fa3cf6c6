"""Queries over symbols, references and import graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph as G
from ..operators import structural as S
from .adapters import IMPORTS_SQL, SYMBOLS_SQL, chunks, import_graph, refs, symbols, table


def find_symbol_exact(s, d):
    return S.find_symbols(symbols(s, d), "f42")


def find_symbol_like(s, d):
    return S.find_symbols(symbols(s, d), "BRAND#1.F1", "function")


def find_refs_tail(s, d):
    return S.find_references(refs(s, d), "f42").unionByName(S.find_references(refs(s, d), "pkg::f77", "call"))


def file_dependencies(s, d):
    return S.dependencies(refs(s, d), "src/m7.rs")


def import_edges(s, d):
    r = refs(s, d).withColumn("to_name", F.col("to_name_tail"))
    return S.import_edges(r, symbols(s, d))


def interval_overlap(s, d):
    ends = symbols(s, d).groupBy("file_path").agg(F.max("line_end").alias("last"))
    c = ends.select("file_path", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - 1) / 30).cast("int"))).alias("k"))
    c = c.select(F.concat("file_path", F.lit("#"), F.col("k").cast("string")).alias("chunk_id"), "file_path", (F.col("k") * 30 + 1).alias("start_line"), (F.col("k") * 30 + 30).alias("end_line"))
    return S.overlapping(c, symbols(s, d)).select("chunk_id", "qualified_name")


def stabbing_first_chunk(s, d):
    ends = symbols(s, d).groupBy("file_path").agg(F.max("line_end").alias("last"))
    c = ends.select("file_path", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 20).cast("int"))).alias("k"))
    c = c.select(F.col("k").cast("bigint").alias("chunk_id"), "file_path", (F.col("k") * 20 + 1).alias("start_line"), (F.col("k") * 20 + 40).alias("end_line"))
    return S.first_chunk(refs(s, d).select(F.col("from_file").alias("file_path"), "line"), c).select("file_path", "line", "chunk_id")


def impact_depth2(s, d):
    sy = symbols(s, d)
    seeds = sy.filter(F.col("file_path").isin("src/m1.rs", "src/m2.rs")).select("name", "qualified_name")
    origins = sy.filter(F.col("file_path").isin("src/m1.rs", "src/m2.rs")).select(F.col("file_path").alias("path"))
    return G.impact(sy, refs(s, d), seeds, depth=2, origins=origins).select("file_path", "distance", "n_reasons")


def impact_analysis(s, d):
    """What a file and a symbol reach, with their reasons."""
    told = lambda hint, x: x.select(F.lit(hint).alias("hint"), "file_path", "distance", "category", "n_reasons", F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["via_symbol"], r["kind"], r["line"].cast("string"))), ",").alias("reasons"))
    parts = [told(h, G.impact_analysis(symbols(s, d), refs(s, d), h)) for h in ("src/m1.rs", "f42", "nowhere")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scc_cycles(s, d):
    return G.components(import_graph(s, d))


def scc_coloured(s, d):
    return G.coloured(import_graph(s, d))


def orphan_anti_join(s, d):
    c = chunks(s, d)
    stored = c.select(F.col("file_path").alias("path"))
    return S.orphans(stored, c.filter("language <> 'de'").select(F.col("file_path").alias("path")))


def hash_delta(s, d):
    c = chunks(s, d).select(F.col("file_path").alias("path"), F.sha2(F.col("content"), 256).alias("content_hash"), "chunk_id")
    stored = c.filter("chunk_id % 3 <> 0").withColumn("content_hash", F.when(F.col("chunk_id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    return S.changed(c.select("path", "content_hash"), stored.select("path", "content_hash"))


def name_tail(s, d):
    p = table(s, d, "part")
    full = F.concat(F.lit("a\\b"), F.col("p_brand"), F.lit("::"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit("/tail")).otherwise(F.lit("")))
    return p.select("p_partkey", names.name_tail(full).alias("tail"))


def table_counts(s, d):
    return S.counts(symbols=symbols(s, d), refs=refs(s, d), chunks=chunks(s, d))


def _sql(body: str) -> str:
    return f"WITH {SYMBOLS_SQL} {body}"


QUERIES = {
    "find_symbol_exact": find_symbol_exact, "find_symbol_like": find_symbol_like, "find_refs_tail": find_refs_tail, "file_dependencies": file_dependencies,
    "import_edges_or_join": import_edges, "interval_overlap": interval_overlap, "stabbing_first_chunk": stabbing_first_chunk, "impact_depth2": impact_depth2, "impact_analysis": impact_analysis,
    "scc_cycles": scc_cycles, "scc_coloured": scc_coloured, "orphan_anti_join": orphan_anti_join, "hash_delta": hash_delta, "name_tail": name_tail, "table_counts": table_counts,
}
_SCC = f"""WITH RECURSIVE {IMPORTS_SQL}, reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT reach.a, edges.dst FROM reach JOIN edges ON reach.b = edges.src),
mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a),
comp AS (SELECT a AS member, min(b) AS component FROM mutual GROUP BY a)
SELECT member, least(member, component) AS component, CAST(count(*) OVER (PARTITION BY least(member, component)) AS INTEGER) AS size FROM comp"""
_CHUNKS = "chunk AS (SELECT doc_id AS chunk_id, source || '/' || doc_id || '.txt' AS path, lang AS language, text FROM documents)"
ORACLES = {
    "find_symbol_exact": _sql("SELECT * FROM symbols WHERE name = 'f42'"),
    "find_symbol_like": _sql("SELECT * FROM symbols WHERE contains(lower(qualified_name), 'brand#1.f1') AND kind = 'function'"),
    "find_refs_tail": _sql("SELECT * FROM refs WHERE to_name_tail = 'f42' UNION ALL SELECT * FROM refs WHERE to_name = 'pkg::f77' AND kind = 'call'"),
    "file_dependencies": _sql("SELECT DISTINCT 'imports' AS direction, to_name AS name FROM refs WHERE kind IN ('import', 'include') AND from_file = 'src/m7.rs' UNION ALL SELECT DISTINCT 'imported_by', from_file FROM refs WHERE kind IN ('import', 'include') AND to_name = 'src/m7.rs'"),
    "import_edges_or_join": _sql("SELECT DISTINCT r.from_file AS src, s.file_path AS dst FROM refs r JOIN symbols s ON s.name = r.to_name_tail OR s.qualified_name = r.to_name_tail WHERE r.kind IN ('import', 'include') AND r.from_file <> s.file_path"),
    "interval_overlap": _sql("SELECT s.file_path || '#' || k AS chunk_id, qualified_name FROM symbols s JOIN (SELECT file_path, unnest(range((max(line_end) - 1) // 30 + 1)) AS k FROM symbols GROUP BY 1) c USING (file_path) WHERE s.line_start <= k * 30 + 30 AND s.line_end >= k * 30 + 1"),
    "stabbing_first_chunk": _sql("SELECT r.from_file AS file_path, r.line, min(k) AS chunk_id FROM (SELECT DISTINCT from_file, line FROM refs) r JOIN (SELECT file_path, unnest(range(max(line_end) // 20 + 1)) AS k FROM symbols GROUP BY 1) c ON c.file_path = r.from_file WHERE r.line BETWEEN k * 20 + 1 AND k * 20 + 40 GROUP BY 1, 2"),
    "impact_depth2": _sql("""
, seeds AS (SELECT DISTINCT name, qualified_name FROM symbols WHERE file_path IN ('src/m1.rs', 'src/m2.rs'))
, r AS (SELECT * FROM refs WHERE from_file NOT IN ('src/m1.rs', 'src/m2.rs'))
, h1 AS (SELECT DISTINCT r.from_file, r.line, s.name FROM r JOIN seeds s ON r.to_name_tail = s.name)
, f2 AS (SELECT DISTINCT s.name FROM h1 JOIN symbols s ON s.file_path = h1.from_file AND h1.line BETWEEN s.line_start AND s.line_end WHERE s.qualified_name NOT IN (SELECT qualified_name FROM seeds))
, h2 AS (SELECT DISTINCT r.from_file, f2.name FROM r JOIN f2 ON r.to_name_tail = f2.name)
SELECT from_file AS file_path, min(d) AS distance, count(DISTINCT name) AS n_reasons FROM (SELECT from_file, name, 1 AS d FROM h1 UNION ALL SELECT from_file, name, 2 FROM h2) GROUP BY 1""").replace(") \n,", ")\n,"),
    "impact_analysis": _sql("""
, asked AS (SELECT * FROM (VALUES ('src/m1.rs'), ('f42')) v(hint))
, seeds AS (SELECT DISTINCT hint, name, qualified_name, file_path FROM asked JOIN symbols s ON s.file_path = hint OR s.name = hint)
, r AS (SELECT a.hint, refs.* FROM asked a, refs WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.hint = a.hint AND s.file_path = from_file))
, h1 AS (SELECT DISTINCT r.hint, r.from_file, r.line, r.kind, s.name, 1 AS d FROM r JOIN seeds s ON s.hint = r.hint AND r.to_name_tail = s.name)
, f2 AS (SELECT DISTINCT h1.hint, s.name FROM h1 JOIN symbols s ON s.file_path = h1.from_file AND h1.line BETWEEN s.line_start AND s.line_end WHERE (h1.hint, s.qualified_name) NOT IN (SELECT (hint, qualified_name) FROM seeds))
, h2 AS (SELECT DISTINCT r.hint, r.from_file, r.line, r.kind, f2.name, 2 AS d FROM r JOIN f2 ON f2.hint = r.hint AND r.to_name_tail = f2.name)
, e AS (SELECT hint, from_file, name, kind, line, min(d) AS d FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL)
, k AS (SELECT *, row_number() OVER (PARTITION BY hint, from_file ORDER BY d, name, line, kind) AS rk FROM e)
SELECT hint, from_file AS file_path, min(d) AS distance, 'source' AS category, count(*) AS n_reasons, string_agg(name || ':' || kind || ':' || line, ',' ORDER BY rk) AS reasons FROM k WHERE rk <= 10 GROUP BY 1, 2""").replace(") \n,", ")\n,"),
    "scc_cycles": _SCC,
    "scc_coloured": _SCC,
    "orphan_anti_join": f"WITH {_CHUNKS} SELECT path FROM chunk WHERE language = 'de' OR language IS NULL",
    "hash_delta": f"WITH {_CHUNKS} SELECT path, sha256(text) AS content_hash FROM chunk WHERE chunk_id % 3 = 0 OR chunk_id % 5 = 0",
    "name_tail": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'tail' ELSE p_name END AS tail FROM part",
    "table_counts": _sql("SELECT 'symbols' AS table_name, count(*) AS n FROM symbols UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'chunks', count(*) FROM documents"),
}
