"""Queries over chunks, vectors, evaluation cases and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import metrics as M
from ..operators import retrieval as R
from .adapters import chunks, table
from .adapters import vectors as vector_table

TERMS = ["license", "apache", "the", "idiot"]


def _first(s, d) -> list[float]:
    rows = table(s, d, "embeddings").orderBy("vec_id").limit(1).collect()
    return list(rows[0].embedding) if rows else []


def _pairs(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    a = e.withColumn("next", F.col("vec_id") + 1)
    return a.join(e.select(F.col("vec_id").alias("next"), F.col("embedding").alias("b")), "next").select("vec_id", F.col("embedding").alias("a"), "b")


def knn_l2(s, d):
    return R.knn(vector_table(s, d), _first(s, d), 10).select("chunk_id", F.round("distance", 5).alias("distance"))


def knn_partitioned(s, d):
    return R.knn(vector_table(s, d), _first(s, d), 10, languages=["l1", "l3"]).select("chunk_id", F.round("distance", 5).alias("distance"))


def knn_filtered_offset(s, d):
    return R.knn(vector_table(s, d), _first(s, d), 10, globs=["d[12]/**"], offset=5).select("chunk_id", F.round("distance", 5).alias("distance"))


def knn_batch(s, d):
    q = table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.knn_many(vector_table(s, d), q, 3).select("query_id", "chunk_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("bigint").alias("rk"))


def vec_l1(s, d):
    return _pairs(s, d).select("vec_id", F.round(vectors.l1(F.col("a"), F.col("b")), 5).alias("l1"))


def vec_cosine(s, d):
    return _pairs(s, d).select("vec_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 5).alias("cosine"))


def vec_hamming_quantized(s, d):
    bits = lambda c: vectors.quantize_bits(F.col(c))
    return _pairs(s, d).select("vec_id", vectors.hamming(bits("a"), bits("b")).cast("bigint").alias("hamming"))


def vec_normalize(s, d):
    doubled = F.transform("a", lambda x: x.cast("double") * 2)
    return _pairs(s, d).select("vec_id", F.round(F.get(vectors.normalize(doubled), F.lit(0)), 5).alias("v0"), F.size(vectors.normalize(F.col("a"))).cast("bigint").alias("n"))


def vec_arithmetic(s, d):
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda x, y: x + y.cast("double"))
    return _pairs(s, d).select("vec_id", F.round(total(vectors.add(F.col("a"), F.col("b"))), 4).alias("added"), F.round(total(vectors.sub(F.col("a"), F.col("b"))), 4).alias("taken"), F.round(total(vectors.cut(F.col("a"), 8, 16)), 4).alias("sliced"))


def vec_quantize_int8(s, d):
    return _pairs(s, d).select("vec_id", F.aggregate(vectors.quantize_int8(F.col("a")), F.lit(0).cast("bigint"), lambda x, y: x + y).alias("total"))


def vec_each(s, d):
    return _pairs(s, d).select("vec_id", F.posexplode("a").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("v").cast("double"), 6).alias("v"))


def rare_literal_gate(s, d):
    asked = s.createDataFrame([("find the LicenseX apache license",), ("a::b",), ("plain words here",), ("read abc.defg",), ("Licensed text",)], "query string")
    return R.has_rare_literal(asked, R.document_frequency(chunks(s, d), ["licensex", "licensed"]))


def rrf_fusion(s, d):
    """The nearest chunks of the first vector and the best chunks by keywords, fused."""
    near = R.knn(vector_table(s, d), _first(s, d), 20).withColumn("rank", F.row_number().over(Window.orderBy("distance", "chunk_id")))
    words = R.bm25(chunks(s, d), TERMS, 20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    return R.fuse(near.select("chunk_id", "rank"), words.select("chunk_id", "rank")).select("chunk_id", F.round("rrf", 8).alias("rrf"), F.round("distance", 8).alias("distance"))


def symbol_boost(s, d):
    x = chunks(s, d).select("chunk_id", "content", F.lit(1.0).alias("score"))
    return R.boosted(x, ["license", "apache", "license"]).filter("boost > 0").select("chunk_id", F.round("score", 6).alias("score"))


def minmax_blend(s, d):
    x = table(s, d, "documents").select("doc_id", "source", F.lit(0.5).alias("score"), F.col("n_chars").cast("double").alias("rerank"))
    return R.blended(x, by=["source"]).select("doc_id", F.round("score", 6).alias("score"))


def search_tokens(s, d):
    return chunks(s, d).select("chunk_id", F.size(text.search_tokens(F.coalesce("content", F.lit("")))).cast("bigint").alias("n"))


def retrieval_metrics(s, d):
    docs = table(s, d, "documents")
    expected = docs.select((F.col("doc_id") % 20).alias("case_id"), F.col("source").alias("path"))
    results = docs.select((F.col("doc_id") % 20).alias("case_id"), F.col("doc_id").alias("rank"), F.concat(F.lit("src"), (F.floor(F.col("doc_id") / 20) % 25).cast("string")).alias("path"))
    return M.retrieval_metrics(expected, results).select("case_id", F.col("first_hit").cast("bigint").alias("first_hit"), "noise", F.round("recall_5", 6).alias("recall_5"), F.round("recall_10", 6).alias("recall_10"))


def percentiles_small_n(s, d):
    return M.small_percentiles(table(s, d, "events"), "value", ["event_type"])


def quality_matrix(s, d):
    e = table(s, d, "events").withColumn("outcome", F.when(F.col("value") < 10, F.lit("empty")).when(F.col("value") < 50, F.lit("ok")).otherwise(F.lit("error")))
    return M.quality_matrix(e, "event_type", "outcome", ["ok", "empty", "error"])


def followup_window(s, d):
    e = M.follow_ups(table(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type"), 3)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("follows", F.lit(False)).cast("bigint")).alias("followed"))


def adjacent_collapse(s, d):
    x = table(s, d, "lineitem").select("l_suppkey", (F.col("l_partkey") * 3).alias("line"))
    return M.islands(x, ["l_suppkey"], "line", gap=60, least=3, distinct=True)


def budget_truncate(s, d):
    x = table(s, d, "documents").select("source", "doc_id", "n_chars")
    return M.within_budget(x, ["source"], ["doc_id"], F.col("n_chars"), 32000).select("source", "doc_id", "used")


def turn_groups(s, d):
    return M.turn_groups(table(s, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", F.col("turn_no").cast("bigint").alias("turn_no"), F.col("pos").cast("bigint").alias("pos"))


def secret_scan(s, d):
    found = M.secret_scan(table(s, d, "documents"), "doc_id", "text", {"token": 'token = "[0-9a-f]{40}"', "mail": r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]+"})
    return found.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "pattern")


def events_tumbling(s, d):
    e = table(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.unix_timestamp(F.col("w.start")).alias("start"), "event_type", "n")


def events_sliding(s, d):
    e = table(s, d, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.unix_timestamp(F.col("w.start")).alias("start"), "n")


def events_session(s, d):
    e = table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (
    knn_l2, knn_partitioned, knn_filtered_offset, knn_batch, vec_l1, vec_cosine, vec_hamming_quantized, vec_normalize, vec_arithmetic, vec_quantize_int8, vec_each,
    rare_literal_gate, rrf_fusion, symbol_boost, minmax_blend, search_tokens, retrieval_metrics, percentiles_small_n, quality_matrix, followup_window,
    adjacent_collapse, budget_truncate, turn_groups, secret_scan, events_tumbling, events_sliding, events_session,
)}

_TOKENS = r"""tokens AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}_]+'), lambda t: t <> '') AS t FROM documents)"""
_FIRST = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_DIST = f"round(list_distance(CAST(embedding AS DOUBLE[]), CAST({_FIRST} AS DOUBLE[])), 5)"
_PAIRS = "pairs AS (SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
_SUM = "list_sum(list_transform(list_zip(a, b), lambda z: {}))"
_IN = "('license', 'apache', 'the', 'idiot')"
ORACLES = {
    "knn_l2": f"SELECT vec_id AS chunk_id, {_DIST} AS distance FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({_FIRST} AS DOUBLE[])), vec_id LIMIT 10",
    "knn_partitioned": f"SELECT vec_id AS chunk_id, {_DIST} AS distance FROM embeddings WHERE label IN (1, 3) ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({_FIRST} AS DOUBLE[])), vec_id LIMIT 10",
    "knn_filtered_offset": f"SELECT vec_id AS chunk_id, {_DIST} AS distance FROM embeddings WHERE vec_id % 5 IN (1, 2) ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({_FIRST} AS DOUBLE[])), vec_id LIMIT 10 OFFSET 5",
    "knn_batch": "SELECT query_id, chunk_id, round(dist, 5) AS distance, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS rk FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS dist FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rk <= 3",
    "vec_l1": f"WITH {_PAIRS} SELECT vec_id, round({_SUM.format('abs(z[1] - z[2])')}, 5) AS l1 FROM pairs",
    "vec_cosine": f"WITH {_PAIRS} SELECT vec_id, round(1 - list_cosine_similarity(a, b), 5) AS cosine FROM pairs",
    "vec_hamming_quantized": f"WITH {_PAIRS} SELECT vec_id, CAST({_SUM.format('CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END')} AS BIGINT) AS hamming FROM pairs",
    "vec_normalize": f"WITH {_PAIRS} SELECT vec_id, round(a[1] / sqrt(list_dot_product(a, a)), 5) AS v0, CAST(len(a) AS BIGINT) AS n FROM pairs",
    "vec_arithmetic": f"WITH {_PAIRS} SELECT vec_id, round({_SUM.format('z[1] + z[2]')}, 4) AS added, round({_SUM.format('z[1] - z[2]')}, 4) AS taken, round(list_sum(a[9:16]), 4) AS sliced FROM pairs",
    "vec_quantize_int8": f"WITH {_PAIRS} SELECT vec_id, CAST(list_sum(list_transform(a, lambda x: greatest(-128, least(127, trunc((x + 1.0) / (2.0 / 255.0) - 128.0))))) AS BIGINT) AS total FROM pairs",
    "vec_each": f"WITH {_PAIRS} SELECT vec_id, i - 1 AS i, round(a[i], 6) AS v FROM pairs, range(1, 65) t(i)",
    "rare_literal_gate": f"WITH {_TOKENS}, f AS (SELECT count(*) FILTER (WHERE list_contains(t, 'licensed')) AS df, count(*) AS n FROM tokens) SELECT q AS query, g AS gated FROM (VALUES ('find the LicenseX apache license', false), ('a::b', true), ('plain words here', false), ('read abc.defg', true)) v(q, g) UNION ALL SELECT 'Licensed text', df > 0 AND df / n < 0.01 FROM f",
    "rrf_fusion": f"""WITH {_TOKENS}, shape AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tokens),
hits AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tokens) WHERE term IN {_IN} GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1),
words AS (SELECT chunk_id, row_number() OVER (ORDER BY sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) DESC, chunk_id) AS rk FROM hits JOIN df USING (term), shape GROUP BY 1),
sem AS (SELECT vec_id, row_number() OVER (ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({_FIRST} AS DOUBLE[])), vec_id) AS rk FROM embeddings)
SELECT chunk_id, round(sum(p), 8) AS rrf, round(greatest(0, 1 - sum(p)), 8) AS distance FROM (SELECT vec_id AS chunk_id, 1.0::DOUBLE / (60 + rk) AS p FROM sem WHERE rk <= 20 UNION ALL SELECT chunk_id, 2.0::DOUBLE / (60 + rk) FROM words WHERE rk <= 20) GROUP BY 1""",
    "symbol_boost": "SELECT doc_id AS chunk_id, CAST(round(1.0 + b, 6) AS DOUBLE) AS score FROM (SELECT doc_id, 0.2 * CAST(contains(lower(text), 'license') AS INT) + 0.1 * CAST(contains(lower(text), 'apache') AS INT) AS b FROM documents) WHERE b > 0",
    "minmax_blend": "SELECT doc_id, round(0.25 + 0.5 * CASE WHEN hi - lo <= 1e-6 THEN 0.5 ELSE (n_chars - lo) / (hi - lo) END, 6) AS score FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(min(n_chars) OVER (PARTITION BY source) AS DOUBLE) AS lo, CAST(max(n_chars) OVER (PARTITION BY source) AS DOUBLE) AS hi FROM documents)",
    "search_tokens": f"WITH {_TOKENS} SELECT chunk_id, CAST(len(t) AS BIGINT) AS n FROM tokens",
    "retrieval_metrics": """WITH e AS (SELECT DISTINCT doc_id % 20 AS case_id, source AS path FROM documents),
r AS (SELECT case_id, path, row_number() OVER (PARTITION BY case_id ORDER BY rk, path) AS rk FROM (SELECT doc_id % 20 AS case_id, 'src' || (doc_id // 20 % 25) AS path, min(doc_id) AS rk FROM documents GROUP BY 1, 2)),
n AS (SELECT case_id, count(*) AS n FROM e GROUP BY 1), ret AS (SELECT case_id, count(*) AS c FROM r GROUP BY 1), h AS (SELECT case_id, min(rk) AS f, count(*) FILTER (WHERE rk <= 5) AS h5, count(*) FILTER (WHERE rk <= 10) AS h10 FROM r JOIN e USING (case_id, path) GROUP BY 1)
SELECT n.case_id, f AS first_hit, coalesce(f - 1, c, 0) AS noise, round(coalesce(h5, 0) / n, 6) AS recall_5, round(coalesce(h10, 0) / n, 6) AS recall_10 FROM n LEFT JOIN ret USING (case_id) LEFT JOIN h USING (case_id)""",
    "percentiles_small_n": "SELECT event_type, count(*) AS n, max(value) FILTER (WHERE r = n // 2) AS p50, CASE WHEN count(*) >= 20 THEN max(value) FILTER (WHERE r = floor(n * 0.95)) ELSE max(value) END AS p95, CASE WHEN count(*) >= 100 THEN max(value) FILTER (WHERE r = floor(n * 0.99)) ELSE max(value) END AS p99, max(value) AS max FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1",
    "quality_matrix": "SELECT CASE WHEN grouping(event_type) = 1 THEN 'total' ELSE event_type END AS event_type, count(*) AS calls, CAST(sum(CAST(o = 'ok' AS INT)) AS BIGINT) AS ok, CAST(sum(CAST(o = 'empty' AS INT)) AS BIGINT) AS empty, CAST(sum(CAST(o = 'error' AS INT)) AS BIGINT) AS error FROM (SELECT event_type, CASE WHEN value < 10 THEN 'empty' WHEN value < 50 THEN 'ok' ELSE 'error' END AS o FROM events) GROUP BY ROLLUP (event_type)",
    "followup_window": "SELECT event_type, count(*) AS n, CAST(sum(CAST(coalesce(f, false) AS INT)) AS BIGINT) AS followed FROM (SELECT event_type, list_contains(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), event_type) AS f FROM events) GROUP BY 1",
    "adjacent_collapse": "WITH x AS (SELECT DISTINCT l_suppkey, l_partkey * 3 AS line FROM lineitem), y AS (SELECT *, CASE WHEN line - lag(line) OVER w > 60 OR lag(line) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM x WINDOW w AS (PARTITION BY l_suppkey ORDER BY line)), z AS (SELECT *, sum(b) OVER (PARTITION BY l_suppkey ORDER BY line) AS g FROM y) SELECT l_suppkey, min(line) AS first, max(line) AS last, count(*) AS n FROM z GROUP BY l_suppkey, g HAVING count(*) >= 3",
    "budget_truncate": "SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) WHERE used <= 32000 OR p = 1",
    "turn_groups": "SELECT conv_id, turn, turn_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn_no ORDER BY turn) - 1 AS pos FROM (SELECT conv_id, turn, CAST(sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM conversations)) WHERE pos <= 39",
    "secret_scan": r"""SELECT doc_id, line_no, pattern FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pattern) AS r FROM (
SELECT doc_id, i AS line_no, unnest(list_filter([CASE WHEN regexp_matches(line, 'token = "[0-9a-f]{40}"') THEN 'token' END, CASE WHEN regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+\.[a-z]+') THEN 'mail' END], lambda p: p IS NOT NULL)) AS pattern
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))) WHERE r <= 5""",
    "events_tumbling": "SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT CAST(epoch(b) AS BIGINT) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day']) AS b FROM events) GROUP BY 1",
    "events_session": "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS b FROM events)) GROUP BY 1, 2) GROUP BY 1",
}
