"""Queries over sessions, requests and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import requests, vectors
from ..operators import retrieval as R
from ..operators import sessions as O
from ..sinks import bundles
from .adapters import NOW, symbols, table
from .adapters import vectors as vector_table
from .retrieve import _DIST, _FIRST, _first


def _questions(text):
    """The invented prose of the tables asks nothing, so questions, commands and tagged parts are put around it."""
    k = F.coalesce((F.col("conv_id") + F.col("turn")) % 5, F.lit(4))
    around = lambda before, after: F.concat(F.lit(before), F.coalesce(text, F.lit("")), F.lit(after))
    return F.when(k == 0, around("Where is ", " handled?")).when(k == 1, around("thanks, where is ", "")).when(k == 2, around("<b>find ", "</b> short ")).when(k == 3, around("<i>", "</i>\n show me the Controller of it")).otherwise(text)


def search_questions(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", requests.is_search_query(_questions(F.col("text"))).alias("asks"))


def _pattern():
    k, name = F.col("p_partkey"), F.col("p_name")
    return F.when(k % 5 == 0, F.concat(name, F.lit("|Other_1"))).when(k % 5 == 1, F.concat(name, F.lit(".*"))).when(k % 5 == 2, F.concat(name, F.lit("||x"))).when(k % 5 == 3, F.lit("a")).otherwise(name)


def identifier_patterns(s, d):
    p = _pattern()
    return table(s, d, "part").select("p_partkey", requests.is_identifier_pattern(p).alias("names"), requests.has_many_identifiers(p).alias("many"))


def _messages(s, d):
    """Conversations in which every answer names files, one of them twice."""
    c = table(s, d, "conversations")
    named = lambda n: F.concat(F.lit('"file_path": "src/f'), n.cast("string"), F.lit('.rs"'))
    files = F.concat_ws(" ", named(F.col("conv_id") % 50), named(F.col("turn")), named(F.col("turn") % 3))
    return c.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select(
        "conv_id", "turn", "m.role", F.when(F.col("m.role") == "user", _questions(F.col("m.text"))).otherwise(files).alias("text")
    )


def mentioned_paths(s, d):
    x = _messages(s, d).select("conv_id", "turn", F.posexplode(requests.mentioned_paths(F.col("text"))).alias("i", "path"))
    return x.select("conv_id", "turn", F.col("i").cast("bigint").alias("i"), "path")


def eval_cases(s, d):
    x = O.eval_cases(_messages(s, d), "conv_id", "turn", "role", "text")
    return x.select("conv_id", "turn", F.size("files").cast("bigint").alias("n"), F.array_join("files", ",").alias("files"))


def normalized_paths(s, d):
    k = F.col("l_partkey")
    p = F.when(k % 4 == 0, F.concat(F.lit("/home/p/"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("/home/p//.git/"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("/tmp/"), k.cast("string"))).otherwise(F.lit("/home/p/"))
    return table(s, d, "lineitem").select(requests.path_in_project(p, "/home/p").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def reads_after(s, d):
    kind = F.col("event_type")
    x = O.reads_after(table(s, d, "events"), "user_id", ["ts", "event_id"], is_result=kind == "error", is_read=kind == "view", is_other_use=kind.isin("click", "purchase", "signup"))
    return x.select("event_id", "reads")


def selection_rates(s, d):
    pattern = F.when(F.col("value") < 20, F.concat(F.lit("name_"), F.col("event_id").cast("string"))).otherwise(F.lit("a.*"))
    x = O.selection_rates(table(s, d, "events"), "user_id", is_own=(F.col("event_type") == "purchase") & (F.col("value") < 30), is_grep=F.col("event_type") == "view", pattern=pattern)
    return x.withColumn("rate", F.round("rate", 9))


def subject_union(s, d):
    x = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("a"), F.collect_set(F.col("l_suppkey").cast("string")).alias("b"))
    return x.select("l_orderkey", F.array_join(O.subjects(F.col("a"), F.col("b")), ",").alias("subjects"))


def duplicate_audit(s, d):
    return O.duplicates(table(s, d, "lineitem").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


def log_rotation(s, d):
    return O.keep_last(table(s, d, "events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


def largest_array(s, d):
    k = F.col("l_orderkey")
    a, b = F.sequence(F.lit(1), k % 9 + 1), F.sequence(F.lit(10), 10 + k % 5)
    x = table(s, d, "lineitem").select("l_orderkey", F.when(k % 11 > 0, F.to_json(F.struct(b.alias("b"), a.alias("a"), F.lit("[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]").alias("text")))).otherwise(F.lit('{"n": 1}')).alias("j")).distinct()
    return x.select("l_orderkey", requests.largest_array(F.col("j")).alias("m")).select("l_orderkey", "m.key", F.col("m.size").cast("bigint").alias("size"))


def response_budget(s, d):
    """A response an order, cut to 20 tokens: objects with two arrays, arrays, and responses without any."""
    k = F.col("l_orderkey")
    a, b = F.sequence(F.lit(1), k % 19 + 1), F.sequence(F.lit(100), 100 + k % 25)
    made = F.when(k % 3 == 0, F.to_json(F.struct(a.alias("a"), b.alias("b"), F.lit("x").alias("text")))).when(k % 3 == 1, F.to_json(b)).otherwise(F.to_json(F.struct(F.repeat(F.lit("y"), (k % 120).cast("int")).alias("text"))))
    x = table(s, d, "lineitem").select("l_orderkey").distinct().select("l_orderkey", requests.capped(made, "orders", 20).alias("j"))
    return x.select("l_orderkey", "j")


def bundle_ingest(s, d):
    """Conversations as bundles of one chunk a turn, of files that the turns name: the counts, the tree and the first line of each chunk."""
    c = table(s, d, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")
    path = F.concat_ws("/", "role", F.concat(F.lit("t"), (F.col("turn") % 3).cast("string")), F.concat(F.lit("f"), (F.col("conv_id") % 5).cast("string"), F.lit(".rs")))
    chunks = c.select(
        F.col("conv_id").cast("string").alias("bundle"), F.when(F.col("role") == "user", "primary").otherwise("related").alias("role"), F.col("turn").alias("pos"), path.alias("file_path"),
        F.lit("rust").alias("language"), F.col("turn").alias("start_line"), (F.col("turn") + 1).alias("end_line"), F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("f(function)"))).alias("symbols"),
    )
    x = bundles.bundle_lines(chunks)
    return x.select("bundle", "part", F.array_join("at", "/").alias("at"), F.substring_index("line", "\n", 1).alias("line"))


def usage_verdict(s, d):
    """Documents as the outputs of calls, their sources as tools; one rule saves a fifth of long outputs, another a tenth of all but short ones."""
    x = table(s, d, "documents").select(F.coalesce("source", F.lit("?")).alias("tool"), F.coalesce("n_chars", F.lit(0)).alias("size"), "text")
    x = x.withColumn("a", F.when(F.col("size") > 1000, F.floor(F.col("size") * 0.8)).otherwise(F.col("size") + 5)).withColumn("b", F.when(F.col("size") > 200, F.floor(F.col("size") * 0.9)).otherwise(F.col("size")))
    summary = O.usage_summary(x, "tool", "size", ["a", "b"], text="text")
    v = O.usage_verdict(summary, "tool")
    return v.select("calls", "bytes", F.round("saved_percent", 6).alias("saved_percent"), "top_tool", F.round("top_percent", 6).alias("top_percent"), "verdict", "targeted")


def harness_summary(s, d):
    """Conversations as tasks: the roles of their turns as tools, the last text as the answer, which should name a word of the first."""
    c = table(s, d, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    t = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m.role"))).alias("x"), F.max_by("m.text", "turn").alias("answer"), F.min_by("m.text", "turn").alias("first"))
    t = t.select((F.col("conv_id") % 4).alias("g"), F.col("x.role").alias("tools"), "answer", F.slice(F.split(F.coalesce("first", F.lit("")), " "), 1, 3).alias("expected"), (F.col("conv_id") % 7).cast("double").alias("cost"), F.lit(None).cast("double").alias("duration"))
    x = O.harness_summary(t, "user", ["g"])
    return x.select("g", "tasks", *[F.round(c, 6).alias(c) for c in ("first", "any", "found", "mean_calls", "cost", "duration")])


def eval_corpus(s, d):
    """Parts as cases: entries with distinct ids for names that repeat."""
    x = table(s, d, "part").select(F.concat(F.lit('Find "'), "p_brand", F.lit("\\ "), F.col("p_size").cast("string"), F.lit('" now!')).alias("query"), "p_partkey", F.array(F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".rs")), F.lit("b.rs")).alias("files"))
    return O.corpus_lines(O.case_ids(x, "query", ["p_partkey"]), "query", "files")


def bundle_totals(s, d):
    x = O.bundle_totals(table(s, d, "conversations").filter("role is not null"), ["conv_id"], "turn", "role", "text")
    return x.withColumn("files", F.array_join("files", ","))


def symbols_of_files(s, d):
    asked = table(s, d, "supplier").select(F.concat(F.lit("src/m"), (F.col("s_suppkey") * 3).cast("string"), F.lit(".rs")).alias("path"))
    return O.symbols_of_files(symbols(s, d), asked).select("file_path", "name", F.col("n").cast("bigint").alias("n"))


def bytes_and_ages(s, d):
    n = F.floor(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 4 == 0, 1).when(F.col("o_orderkey") % 4 == 1, 0.001).when(F.col("o_orderkey") % 4 == 2, 37).otherwise(90000))
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.when(F.col("o_orderkey") % 3 == 0, F.lit(NOW) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - F.col("o_orderkey") % 90000).otherwise(0)
    return table(s, d, "orders").select("o_orderkey", requests.bytes_text(n).alias("bytes"), requests.age_text(ts, NOW).alias("age"))


def numeric_coercion(s, d):
    k = F.col("o_orderkey")
    written = F.when(k % 6 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 6 == 1, F.lit("")).when(k % 6 == 2, F.concat(F.lit("-"), k.cast("string"))).when(k % 6 == 3, F.lit("1.5")).when(k % 6 == 4, F.lit("ten")).otherwise(k.cast("string"))
    return table(s, d, "orders").select("o_orderkey", requests.count_of(written).alias("n"))


def target_kinds(s, d):
    k = F.col("p_partkey")
    hint = F.when(k % 3 == 0, F.concat(F.lit("src/"), F.col("p_name"))).when(k % 3 == 1, F.concat("p_name", F.lit(".rs"))).otherwise(F.translate("p_name", " #./", ""))
    return table(s, d, "part").select("p_partkey", requests.target_kind(hint).alias("kind"), requests.target_kind(hint, False).alias("forced"))


def vec_shape(s, d):
    e = table(s, d, "embeddings")
    kind = vectors.kind(e.schema["embedding"].dataType.elementType.typeName())
    return e.select("vec_id", vectors.length(F.col("embedding")).cast("bigint").alias("n"), F.lit(kind).alias("kind"))


def knn_constrained(s, d):
    """Ids, a metadata range and exclusive bounds on the distance."""
    where = (F.col("chunk_id") % 3 != 0) & (F.col("chunk_id") >= 10) & ~F.col("language").isin("l2")
    return R.knn(vector_table(s, d), _first(s, d), 10, where=where, farther_than=0.5, nearer_than=1000.0).select("chunk_id", F.round("distance", 5).alias("distance"))


QUERIES = {f.__name__: f for f in (
    search_questions, identifier_patterns, mentioned_paths, eval_cases, normalized_paths, reads_after, selection_rates, subject_union, duplicate_audit, log_rotation,
    largest_array, response_budget, bundle_ingest, usage_verdict, harness_summary, eval_corpus, bundle_totals, symbols_of_files, bytes_and_ages, numeric_coercion, target_kinds, vec_shape, knn_constrained,
)}


def _any(words: tuple[str, ...], test: str) -> str:
    return "(" + " OR ".join(f"{test}(low, '{w}')" for w in words) + ")"


_ASKS = f"(length(bare) BETWEEN 15 AND 500 AND NOT {_any(requests.SKIPPED_OPENINGS, 'starts_with')} AND {_any(requests.SEARCH_SIGNALS, 'contains')})"


def _bare(source: str) -> str:
    return rf"(SELECT *, lower(bare) AS low FROM (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>.*?</[^>]+>', '', 'gs'), '^\s+|\s+$', '', 'g') AS bare FROM {source}))"


_QUESTIONS = """CASE coalesce((conv_id + turn) % 5, 4) WHEN 0 THEN 'Where is ' || coalesce(text, '') || ' handled?' WHEN 1 THEN 'thanks, where is ' || coalesce(text, '')
  WHEN 2 THEN '<b>find ' || coalesce(text, '') || '</b> short ' WHEN 3 THEN '<i>' || coalesce(text, '') || '</i>' || chr(10) || ' show me the Controller of it' ELSE text END"""
_MESSAGES = f"""m0 AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS r FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
msgs AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {_QUESTIONS} END AS text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM m0 WHERE r = 1),
named AS (SELECT conv_id, turn, g, 'src/f' || n || '.rs' AS path, i FROM (SELECT *, unnest([conv_id % 50, turn, turn % 3]) AS n, unnest([0, 1, 2]) AS i FROM msgs WHERE role IS DISTINCT FROM 'user'))"""
_BYTES = "CAST(floor(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.001::DOUBLE WHEN 2 THEN 37 ELSE 90000 END) AS BIGINT)"
ORACLES = {
    "search_questions": f"SELECT conv_id, turn, {_ASKS} AS asks FROM {_bare(f'(SELECT conv_id, turn, {_QUESTIONS} AS text FROM conversations)')}",
    "identifier_patterns": r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '|Other_1' WHEN 1 THEN p_name || '.*' WHEN 2 THEN p_name || '||x' WHEN 3 THEN 'a' ELSE p_name END AS p FROM part),
a AS (SELECT p_partkey, p, unnest(string_split(p, '|')) AS alt FROM p),
t AS (SELECT p_partkey, alt, list_filter(regexp_split_to_array(alt, '\s+'), lambda x: x <> '') AS w FROM a),
ok AS (SELECT p_partkey, bool_and(len(w) > 0 AND len(list_filter(w, lambda x: NOT regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))) = 0) AS fine, sum(len(w)) AS n FROM t GROUP BY 1)
SELECT p_partkey, fine AND length(p) >= 2 AS names, fine AND length(p) >= 2 AND n > 1 AS many FROM ok JOIN p USING (p_partkey)""",
    "mentioned_paths": f"WITH {_MESSAGES}, f AS (SELECT conv_id, turn, path, min(i) AS i FROM named GROUP BY ALL) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS i, path FROM f",
    "eval_cases": f"""WITH {_MESSAGES}, asked AS (SELECT conv_id, turn, g FROM {_bare("msgs")} WHERE role = 'user' AND {_ASKS})
SELECT a.conv_id, a.turn, count(DISTINCT path) AS n, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM asked a JOIN named f ON f.conv_id = a.conv_id AND f.g = a.g GROUP BY 1, 2""",
    "normalized_paths": "SELECT CASE WHEN l_partkey % 4 = 0 THEN CAST(l_partkey AS VARCHAR) END AS path, count(*) AS n FROM lineitem GROUP BY 1",
    "reads_after": """WITH g AS (SELECT *, sum(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g,
  sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events)
SELECT event_id, CAST(max(v) OVER (PARTITION BY user_id, g) - v AS BIGINT) AS reads FROM g QUALIFY event_type = 'error'""",
    "selection_rates": """WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value < 30) AS own, count(*) FILTER (WHERE event_type = 'view' AND value < 20) AS greps FROM events GROUP BY 1)
SELECT count(*) AS sessions, count(*) FILTER (WHERE own > 0) AS sessions_with_own, CAST(sum(own) AS BIGINT) AS own_calls, CAST(sum(greps) FILTER (WHERE own > 0) AS BIGINT) AS identifier_greps,
  round(sum(own) / (sum(own) + sum(greps) FILTER (WHERE own > 0)), 9) AS rate FROM s""",
    "subject_union": "SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS subjects FROM (SELECT DISTINCT l_orderkey, CAST(unnest([l_partkey, l_suppkey]) AS VARCHAR) AS x FROM lineitem) GROUP BY 1",
    "duplicate_audit": "SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "log_rotation": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    "usage_verdict": r"""WITH x AS (SELECT coalesce(source, '?') AS tool, coalesce(n_chars, 0) AS size, coalesce(regexp_matches(text, '^(MCP error|Error:|Exit code \d+)'), false) AS failed FROM documents),
y AS (SELECT *, CASE WHEN failed THEN 0 ELSE greatest(0, size - least(CASE WHEN size > 1000 THEN floor(size * 0.8) ELSE size + 5 END, CASE WHEN size > 200 THEN floor(size * 0.9) ELSE size END)) END AS saved FROM x),
t AS (SELECT tool, sum(size) AS b FROM y GROUP BY 1 ORDER BY b DESC, tool DESC LIMIT 1), n AS (SELECT count(*) AS calls, CAST(sum(size) AS BIGINT) AS bytes, 100.0 * sum(saved) / sum(size) AS p FROM y)
SELECT calls, bytes, round(CAST(p AS DOUBLE), 6) AS saved_percent, tool AS top_tool, round(CAST(100.0 * b / bytes AS DOUBLE), 6) AS top_percent, CASE WHEN calls < 20 THEN 'inconclusive' WHEN p < 10 THEN 'not worth it' WHEN p < 25 THEN 'marginal' ELSE 'promote' END AS verdict, 100.0 * b / bytes > 80 AS targeted FROM n, t""",
    "harness_summary": """WITH c AS (SELECT conv_id, turn, min((role, text)) AS m FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2),
t AS (SELECT conv_id, list(m[1] ORDER BY turn) AS tools, coalesce(arg_max(m[2], turn), '') AS answer, string_split(coalesce(arg_min(m[2], turn), ''), ' ')[1:3] AS expected FROM c GROUP BY 1)
SELECT conv_id % 4 AS g, count(*) AS tasks, round(avg(CAST(starts_with(tools[1], 'user') AS DOUBLE)), 6) AS first, round(avg(CAST(len(list_filter(tools, lambda r: starts_with(r, 'user'))) > 0 AS DOUBLE)), 6) AS any,
  round(avg(CAST(len(list_filter(expected, lambda p: trim(p) <> '' AND contains(answer, p))) > 0 AS DOUBLE)), 6) AS found, round(avg(len(tools)), 6) AS mean_calls, round(sum(CAST(conv_id % 7 AS DOUBLE)), 6) AS cost, 0.0::DOUBLE AS duration FROM t GROUP BY 1""",
    "eval_corpus": r"""WITH x AS (SELECT p_partkey AS k, 'Find "' || p_brand || '\ ' || p_size || '" now!' AS query FROM part), y AS (SELECT *, trim(regexp_replace(lower(query), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM x),
z AS (SELECT *, 'session-' || slug || CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY k) > 1 THEN '-' || row_number() OVER (PARTITION BY slug ORDER BY k) ELSE '' END AS case_id FROM y)
SELECT case_id, '  - id: ' || case_id || chr(10) || '    source: session' || chr(10) || '    query: "' || replace(replace(query, '\', '\\'), '"', '\"') || '"' || chr(10) || '    expected_files:' || chr(10) || '      - src/f' || k || '.rs' || chr(10) || '      - b.rs' AS text FROM z""",
    "response_budget": """WITH x AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
y AS (SELECT k, list_transform(range(1, k % 19 + 2), lambda v: CAST(v AS VARCHAR)) AS a, list_transform(range(100, 101 + k % 25), lambda v: CAST(v AS VARCHAR)) AS b, repeat('y', CAST(k % 120 AS INTEGER)) AS t FROM x),
z AS (SELECT *, length(array_to_string(a, ',')) + 2 AS la, length(array_to_string(b, ',')) + 2 AS lb FROM y),
w AS (SELECT *, CASE WHEN k % 3 = 0 THEN '{"a":[' || array_to_string(a, ',') || '],"b":[' || array_to_string(b, ',') || '],"text":"x"}' WHEN k % 3 = 1 THEN '[' || array_to_string(b, ',') || ']' ELSE '{"text":"' || t || '"}' END AS whole,
  CASE WHEN k % 3 = 1 OR lb > la THEN b ELSE a END AS items, CASE WHEN k % 3 = 1 THEN 80 ELSE greatest(0, 80 - (la + lb + 22 - greatest(la, lb))) END AS room FROM z),
v AS (SELECT *, greatest(1, len(list_filter(range(1, len(items) + 1), lambda n: list_sum(list_transform(items[1:n], lambda i: length(i))) <= room))) AS n FROM w)
SELECT k AS l_orderkey, CASE WHEN length(whole) <= 80 OR k % 3 = 2 THEN whole
  WHEN k % 3 = 1 THEN '{"_meta":{"approx_tokens_budget":20,"hint":"output exceeded budget; refine query, narrow scope (paths/language), or call with offset to paginate","kind":"orders","returned":' || n || ',"total_results":' || len(b) || ',"truncated":true},"results":[' || array_to_string(b[1:n], ',') || ']}'
  ELSE '{"_meta":{"approx_tokens_budget":20,"field":"' || CASE WHEN lb > la THEN 'b' ELSE 'a' END || '","hint":"output exceeded budget; refine query or narrow scope","kind":"orders","returned":' || n || ',"total_results":' || len(items) || ',"truncated":true},"a":['
    || array_to_string(CASE WHEN lb > la THEN a ELSE a[1:n] END, ',') || '],"b":[' || array_to_string(CASE WHEN lb > la THEN b[1:n] ELSE b END, ',') || '],"text":"x"}' END AS j FROM v""",
    "bundle_ingest": r"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS bundle, role = 'user' AS prim, turn, role || '/t' || (turn % 3) || '/f' || (conv_id % 5) || '.rs' AS path, coalesce(text, '') AS text FROM conversations WHERE role IS NOT NULL),
n AS (SELECT bundle, count(*) AS n, count(DISTINCT path) AS files, count(*) FILTER (WHERE prim) AS p, count(*) FILTER (WHERE NOT prim) AS r, sum(octet_length(encode(text))) AS chars FROM c GROUP BY 1),
f AS (SELECT DISTINCT bundle, string_split(path, '/') AS p FROM c),
nodes AS (SELECT DISTINCT bundle, p[1:k] AS p, k FROM f, range(1, 4) t(k)),
marks AS (SELECT *, p[k] = max(p[k]) OVER (PARTITION BY bundle, p[1:k - 1]) AS last FROM nodes),
tree AS (SELECT m.bundle, m.p, coalesce((SELECT string_agg(CASE WHEN o.last THEN '    ' ELSE '│   ' END, '' ORDER BY o.k) FROM marks o WHERE o.bundle = m.bundle AND o.k < m.k AND o.p = m.p[1:o.k]), '')
  || CASE WHEN m.last THEN '└── ' ELSE '├── ' END || m.p[m.k] || CASE WHEN m.k < 3 THEN '/' ELSE '' END AS line FROM marks m)
SELECT bundle, 0 AS part, '0' AS "at", 'Counts: ' || n || ' chunks across ' || files || ' files (' || p || ' primary, ' || r || ' related)' AS line FROM n
UNION ALL SELECT bundle, 0, '1', 'Approx tokens: ~' || CAST(chars // 4 AS BIGINT) FROM n UNION ALL SELECT bundle, 1, array_to_string(p, '/'), line FROM tree
UNION ALL SELECT bundle, 3, CASE WHEN prim THEN '0' ELSE '1' END || '/' || lpad(CAST(turn AS VARCHAR), 19, '0'), '=== ' || path || ':' || turn || '-' || (turn + 1) || ' lang=rust' || CASE WHEN turn % 2 = 0 THEN ' symbols=[f(function)]' ELSE '' END || ' ===' FROM c""",
    "largest_array": """WITH x AS (SELECT DISTINCT l_orderkey, l_orderkey % 9 + 1 AS a, l_orderkey % 5 + 1 AS b FROM lineitem), y AS (SELECT l_orderkey, 2 * a + 1 AS a, 3 * b + 1 AS b FROM x)
SELECT l_orderkey, CASE WHEN l_orderkey % 11 > 0 THEN CASE WHEN a >= b THEN 'a' ELSE 'b' END END AS key, CASE WHEN l_orderkey % 11 > 0 THEN CAST(greatest(a, b) AS BIGINT) END AS size FROM y""",
    "bundle_totals": """WITH f AS (SELECT conv_id, role, min(turn) AS pos FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2), n AS (SELECT conv_id, string_agg(role, ',' ORDER BY pos NULLS FIRST, role) AS files FROM f GROUP BY 1)
SELECT c.conv_id, count(*) AS chunks, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, CAST(sum(strlen(coalesce(text, ''))) // 4 AS BIGINT) AS tokens, any_value(files) AS files
FROM conversations c JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id WHERE role IS NOT NULL GROUP BY 1""",
    "symbols_of_files": """WITH s AS (SELECT 'f' || p_partkey AS name, p_partkey % 200 AS m, p_partkey // 200 AS pos FROM part)
SELECT 'src/m' || m || '.rs' AS file_path, name, row_number() OVER (PARTITION BY m ORDER BY pos, name) AS n FROM s WHERE m IN (SELECT s_suppkey * 3 FROM supplier)""",
    "bytes_and_ages": f"""WITH o AS (SELECT o_orderkey, {_BYTES} AS n, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 90000 ELSE {NOW} - CAST(epoch(o_orderdate) AS BIGINT) END AS ago FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS bytes,
  CASE WHEN ago < 0 THEN 'in the future? ts=' || ({NOW} - ago) WHEN ago < 60 THEN 'just now' WHEN ago < 120 THEN '1 minute ago' WHEN ago < 3600 THEN (ago // 60) || ' minutes ago'
    WHEN ago < 7200 THEN '1 hour ago' WHEN ago < 86400 THEN (ago // 3600) || ' hours ago' WHEN ago < 172800 THEN '1 day ago' ELSE (ago // 86400) || ' days ago' END AS age FROM o""",
    "numeric_coercion": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 5) THEN o_orderkey END AS n FROM orders",
    "target_kinds": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'file' ELSE 'symbol' END AS kind, 'symbol' AS forced FROM part",
    "vec_shape": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, 'float32' AS kind FROM embeddings",
    "knn_constrained": f"SELECT chunk_id, distance FROM (SELECT vec_id AS chunk_id, {_DIST} AS distance, list_distance(CAST(embedding AS DOUBLE[]), CAST({_FIRST} AS DOUBLE[])) AS x FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id >= 10 AND label <> 2) WHERE x > 0.5 AND x < 1000 ORDER BY x, chunk_id LIMIT 10",
}
