"""Retrieval: vector neighbours, keyword ranking, fusion, boosts and blending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .. import scratch
from ..functions import paths, text, vectors

DISTANCES = {"l2": vectors.l2, "l1": vectors.l1, "cosine": vectors.cosine}


def knn(chunks: DataFrame, query: Sequence[float], k: int, *, metric: str = "l2", languages: Sequence[str] = (), globs: Sequence[str] = (), where: Column | None = None, farther_than: float | None = None, nearer_than: float | None = None, offset: int = 0, key: str = "chunk_id") -> DataFrame:
    """The k nearest rows, after offset, with their distance; filters apply before any distance is computed.

    ``where`` is any condition on the other columns; the bounds on the distance are exclusive. Rows without a vector take no part.

    A top-k per partition is merged, so only offset + k rows of each partition move.
    """
    if not 0 <= k <= 4096:
        raise ValueError("k must lie in 0..4096")
    x = chunks.filter(F.col("embedding").isNotNull())
    if languages:
        x = x.filter(F.col("language").isin(*languages))
    if globs:
        x = x.filter(paths.any_glob(F.col("file_path"), globs))
    d = DISTANCES[metric](F.col("embedding"), F.lit([float(v) for v in query]))
    x = x.filter(where) if where is not None else x
    x = x.withColumn("distance", d)
    x = x.filter(F.col("distance") > farther_than) if farther_than is not None else x
    x = x.filter(F.col("distance") < nearer_than) if nearer_than is not None else x
    return x.orderBy("distance", key).offset(offset).limit(k)


def knn_many(chunks: DataFrame, queries: DataFrame, k: int, *, key: str = "chunk_id", block: int = C.QUERY_BLOCK) -> DataFrame:
    """query_id, key, distance, rank for a table of queries (query_id, query); exact, a scan of chunks for each block of about ``block`` queries.

    Each task multiplies its rows with a block of queries and keeps the k nearest of each query, so no pairs of rows and queries are made in Spark and k rows a
    query and task are shuffled. Rows and queries without a vector take no part; ties go to the smaller key.
    """
    asked = queries.filter(F.col("query").isNotNull())
    blocks = max(1, -(-asked.count() // block))
    kind, id_kind = chunks.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    rows, out = chunks.filter(F.col("embedding").isNotNull()).select(F.col(key).alias("key"), "embedding"), None
    for n in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).select("query_id", "query").collect()  # about block rows
        x = rows.mapInPandas(_nearest([r.query_id for r in some], [list(r.query) for r in some], k), f"query_id {id_kind}, key {kind}, distance double").withColumnRenamed("key", key)
        x = x.withColumn("rank", rank).filter(F.col("rank") <= k)
        out = x if out is None else out.unionByName(x)
    return out


def _nearest(ids: list, queries: list[list[float]], k: int, rows_each: int = 1024):
    """A function over batches (key, embedding) that gives each query's k nearest rows of a partition.

    Products of matrices tell which rows may be among them; these are measured by differences, so that equal vectors have equal distances.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        q = np.array(queries, dtype=np.float64)
        squares = (q * q).sum(axis=1) if len(q) else q
        best = pd.DataFrame({"q": np.zeros(0, dtype=np.int64), "distance": np.zeros(0), "key": []})
        reach = np.full(len(q), np.inf)
        for batch in batches if len(q) and k > 0 else ():
            for at in range(0, len(batch), rows_each):
                part = batch.iloc[at : at + rows_each]
                x = np.array(part["embedding"].tolist(), dtype=np.float64)
                own = (x * x).sum(axis=1)
                near = squares[:, None] + own[None, :] - 2.0 * (q @ x.T)
                slack = 1e-9 * (squares + own.max() + 1.0)
                kth = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) >= k else np.full(len(q), np.inf)
                i, j = np.nonzero(near <= (np.minimum(kth, reach) + slack)[:, None])
                apart = x[j] - q[i]
                found = pd.DataFrame({"q": i, "distance": np.sqrt((apart * apart).sum(axis=1)), "key": part["key"].to_numpy()[j]})
                best = pd.concat([best, found], ignore_index=True).sort_values(["q", "distance", "key"]).groupby("q").head(k)
                full = best.groupby("q")["distance"].agg(["size", "max"])
                full = full[full["size"] >= k]
                reach[full.index.to_numpy(dtype=np.int64)] = full["max"].to_numpy() ** 2
        yield pd.DataFrame({"query_id": [ids[n] for n in best["q"]], "key": best["key"].tolist(), "distance": best["distance"].to_numpy()})

    return run


def postings(chunks: DataFrame, *, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """(term, key, tf, doc_len)."""
    x = chunks.select(key, text.search_tokens(F.coalesce(F.col(content), F.lit(""))).alias("t"))
    return x.select(key, F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def document_frequency(chunks: DataFrame, terms: Sequence[str], *, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """(term, df, total) of the given terms; terms that occur nowhere have none."""
    x = chunks.select(key, F.array_distinct(text.search_tokens(F.coalesce(F.col(content), F.lit("")))).alias("t"))
    wanted = F.lit([t.lower() for t in terms])
    found = x.select(F.explode(F.array_intersect("t", wanted)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return found.join(F.broadcast(x.agg(F.count("*").alias("total"))))


def bm25(chunks: DataFrame, terms: Sequence[str], k: int | None = None, *, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """(key, score): a sum over the terms, each once; greater is better. Chunks are scanned once for lengths and once for hits."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    x = chunks.select(key, text.search_tokens(F.coalesce(F.col(content), F.lit(""))).alias("t"))
    shape = x.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))
    wanted = F.lit(terms)
    hits = x.select(key, F.size("t").alias("dl"), F.explode(F.filter("t", lambda w: F.array_contains(wanted, w))).alias("term"))
    tf = hits.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    y = tf.join(F.broadcast(df), "term").join(F.broadcast(shape))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(C.IDF_FLOOR))
    part = idf * F.col("tf") * (C.BM25_K1 + 1) / (F.col("tf") + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("dl") / F.col("mean")))
    out = y.groupBy(key).agg(F.sum(part).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def has_rare_literal(queries: DataFrame, frequencies: DataFrame, *, query: str = "query") -> DataFrame:
    """queries with ``gated``: whether a query names something literally, so that keyword ranking should join in.

    frequencies: term, df, total.
    """
    q = F.col(query)
    plain = q.contains("::") | q.contains("`") | q.contains("*.") | (F.size(text.dotted_pairs(q)) > 0)
    toks = F.filter(text.gate_tokens(q), lambda t: (F.octet_length(t) >= C.RARE_MIN_BYTES) & text.looks_like_code(t))
    x = queries.withColumn("_plain", plain)
    t = x.select(query, F.explode(toks).alias("term")).withColumn("term", F.lower("term")).distinct()
    rare = t.join(frequencies, "term").filter((F.col("df") > 0) & (F.col("df") / F.col("total") < C.RARE_SHARE)).select(query).distinct().withColumn("_rare", F.lit(True))
    return x.join(rare, query, "left").withColumn("gated", F.col("_plain") | F.coalesce("_rare", F.lit(False))).drop("_plain", "_rare")


def fuse(semantic: DataFrame, keyword: DataFrame, *, key: str = "chunk_id", by: Sequence[str] = ()) -> DataFrame:
    """Reciprocal ranks of both lists added up, the keyword list twice. Each list has key and rank (from 1), per ``by``."""
    cols = [*by, key]
    a = semantic.select(*cols, (1.0 / (C.RRF_K + F.col("rank"))).alias("part"))
    b = keyword.select(*cols, (2.0 / (C.RRF_K + F.col("rank"))).alias("part"))
    out = a.unionByName(b).groupBy(*cols).agg(F.sum("part").alias("rrf"))
    return out.withColumn("distance", F.greatest(F.lit(0.0), 1.0 - F.col("rrf")))


def known_names(query: str, symbols: DataFrame) -> list[str]:
    """The query's tokens that look like identifiers and name a symbol, lower-cased; a repeated token counts each time."""
    import re

    tokens = [re.sub(r"^[^\w]+|[^\w]+$", "", t) for t in re.split(r"[\s,;]+", query)]
    tokens = [t for t in tokens if len(t.encode()) >= 3 and re.match(r"[^\W\d]|_", t) and ("_" in t or t != t.lower() or (re.fullmatch(r"\w+", t) and len(t) >= 4))]
    if not tokens:
        return []
    spelt = symbols.select(F.explode(F.array("name", "qualified_name")).alias("n")).filter(F.col("n").isin(*set(tokens)))
    there = {r.n for r in spelt.distinct().collect()}  # as many as the query has tokens, at most
    return [t.lower() for t in tokens if t in there]


def boosted(results: DataFrame, names: Sequence[str], *, content: str = "content") -> DataFrame:
    extra = F.lit(0.0)
    for n in names:
        extra = extra + F.when(F.contains(F.lower(content), F.lit(n)), F.lit(C.SYMBOL_BOOST)).otherwise(F.lit(0.0))
    return results.withColumn("boost", extra).withColumn("score", F.col("score") + F.col("boost"))


def blended(results: DataFrame, *, by: Sequence[str] = (), raw: str = "rerank") -> DataFrame:
    """Half the score and half the other scorer's value, scaled to 0..1 within each query; 0.5 where all values are alike."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    low, high = F.min(raw).over(w), F.max(raw).over(w)
    unit = F.when(high - low <= 1e-6, F.lit(0.5)).otherwise((F.col(raw) - low) / F.greatest(high - low, F.lit(1e-12)))
    return results.withColumn("score", 0.5 * F.col("score") + 0.5 * unit)


def gate_of(query: str, spark) -> tuple[bool, list[str], list[str]]:
    """Of a query: whether its form alone names something literally, the long tokens that may do so by being rare, and its keyword terms."""
    q = F.col("query")
    long = F.filter(text.gate_tokens(q), lambda t: (F.octet_length(t) >= C.RARE_MIN_BYTES) & text.looks_like_code(t))
    plain = q.contains("::") | q.contains("`") | q.contains("*.") | (F.size(text.dotted_pairs(q)) > 0)
    # one literal row, which the optimizer evaluates without a job
    r = spark.sql("SELECT :q AS query", args={"q": query}).select(plain, F.transform(long, F.lower), text.match_terms(q)).first()
    return r[0], r[1], r[2]


def search(chunks: DataFrame, symbols: DataFrame, query: str, embedding: Sequence[float], *, index=None, limit: int = 10, offset: int = 0, languages: Sequence[str] = (), globs: Sequence[str] = (), reranker=None) -> DataFrame:
    """Hybrid search: vector neighbours, keyword ranking where the query names something rare, symbol boost, optional reranking.

    index is the chunks' inverted index (``inverted.Postings``); without one keywords are ranked by a scan. reranker: a function of
    (content column) that gives a raw score column. Filters apply to both lists, the keyword statistics are those of the whole index.
    """
    from . import inverted, structural

    names = known_names(query, symbols)
    wide = (limit + offset) * (5 if reranker else 3 if names else 1)
    near = knn(chunks, query=embedding, k=min(4096, wide), languages=languages, globs=globs)
    gated, rare, terms = gate_of(query, chunks.sparkSession)
    if not gated and rare and terms:
        known = {r.term: (r.df, r.total) for r in (document_frequency(chunks, rare) if index is None else inverted.document_frequency(index, rare)).collect()}
        gated = any(0 < df / total < C.RARE_SHARE for df, total in known.values())
    x = near.select("chunk_id", "distance")
    if gated and terms:
        allowed = chunks
        if languages:
            allowed = allowed.filter(F.col("language").isin(*languages))
        if globs:
            allowed = allowed.filter(paths.any_glob(F.col("file_path"), globs))
        within = allowed.select("chunk_id") if languages or globs else None
        if index is None:
            kw = bm25(chunks, terms)
            kw = (kw if within is None else kw.join(within, "chunk_id", "left_semi")).orderBy(F.desc("score"), "chunk_id").limit(wide)
        else:
            kw = inverted.bm25(index, terms, wide, within=within)
        # both lists are as long as asked for, at most
        kw = kw.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
        sem = x.withColumn("rank", F.row_number().over(Window.orderBy("distance", "chunk_id")))
        x = fuse(sem, kw).orderBy("distance", "chunk_id").limit(wide).select("chunk_id", "distance")
    y = chunks.drop("embedding").join(F.broadcast(x), "chunk_id").withColumn("score", vectors.score_of_distance(F.col("distance")))
    y = boosted(y, names)
    if reranker is not None and not (gated and terms):
        y = blended(y.withColumn("rerank", reranker(F.col("content")))).drop("rerank")
    # the few results are read several times, here and by what follows
    y = scratch.written(y.orderBy(F.desc("score"), "distance", "chunk_id").offset(offset).limit(limit), "results")
    told = structural.overlapping(y, symbols, few=True).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("line_start", "qualified_name", "kind"))).alias("symbols"))
    return y.join(told, "chunk_id", "left").orderBy(F.desc("score"), "distance", "chunk_id")


def _around(places: DataFrame, chunks: DataFrame, role: str, primary: DataFrame) -> DataFrame:
    """(role, chunk_id, name): the first chunk around each of a few places (file_path, line) that is no primary one."""
    from . import structural

    x = structural.first_chunk(places, chunks, few=True).select("chunk_id").distinct().join(F.broadcast(primary.select("chunk_id")), "chunk_id", "left_anti")
    return x.select(F.lit(role).alias("role"), "chunk_id", F.lit(None).cast("string").alias("name"))


def _references(names: DataFrame, refs: DataFrame, each: int) -> DataFrame:
    """The first ``each`` places (file_path, line) that refer to each of a few names."""
    found = refs.join(F.broadcast(names.select(F.col("name").alias("to_name_tail")).distinct()), "to_name_tail").select("to_name_tail", F.col("from_file").alias("file_path"), "line")
    rank = F.row_number().over(Window.partitionBy("to_name_tail").orderBy("file_path", "line"))
    return found.withColumn("r", rank).filter(F.col("r") <= each).select("file_path", "line")


def context_of_query(results: DataFrame, refs: DataFrame, chunks: DataFrame, symbols: DataFrame, *, callers: bool = True, callees: bool = True, each: int = 3, most_symbols: int = 5) -> DataFrame:
    """A bundle of context for search results: rows (role, chunk_id, name).

    primary: the results. definition: the first definition of each symbol that a result holds, by its qualified name. For the first few
    of these, in the order of results and lines, caller: chunks around references to it, and callee: the chunk around its definition; no chunk is
    given twice in a role, nor a primary one again.
    """
    from . import structural

    rank = F.row_number().over(Window.orderBy(F.desc("score"), "distance", "chunk_id"))
    # tables of a few rows, which stand for the search and the scans that led to them
    primary = scratch.written(results.select("chunk_id", "file_path", "start_line", "end_line", rank.alias("at")), "primary")
    held = structural.overlapping(primary, symbols, few=True).join(F.broadcast(primary.select("chunk_id", "at")), "chunk_id")
    held = held.groupBy("qualified_name").agg(F.min(F.struct("at", "line_start")).alias("o"))
    held = held.join(symbols.select("name", "qualified_name").distinct(), "qualified_name").select("o", F.col("qualified_name").alias("held"), "name")
    spelt = symbols.join(F.broadcast(held), "name").groupBy("held", "o", "name").agg(F.min(F.struct("file_path", "line_start", "qualified_name")).alias("d"))
    spelt = scratch.written(spelt, "spelt")
    few = spelt.orderBy("o", "held").limit(most_symbols)
    out = primary.select(F.lit("primary").alias("role"), "chunk_id", F.lit(None).cast("string").alias("name"))
    out = out.unionByName(spelt.select(F.lit("definition").alias("role"), F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), F.col("d.qualified_name").alias("name")).distinct())
    if callers:
        out = out.unionByName(_around(_references(few, refs, each), chunks, "caller", primary))
    if callees:
        out = out.unionByName(_around(few.select("d.file_path", F.col("d.line_start").alias("line")), chunks, "callee", primary))
    return out


def context_of_symbol(symbol: str, refs: DataFrame, chunks: DataFrame, symbols: DataFrame, *, callers: bool = True, limit: int = 10) -> tuple[str, DataFrame]:
    """A bundle of context for a symbol: what it is about, and rows (role, chunk_id, name) as in ``context_of_query``.

    primary: the chunks around the symbol's definitions; caller: chunks around its first ``limit`` references. A symbol that isn't defined has no rows, and is
    said not to be found.
    """
    from . import structural

    defs = structural.find_symbols(symbols, symbol).select("file_path", F.col("line_start").alias("line"), "qualified_name")
    if defs.isEmpty():
        return f"symbol: {symbol} (not found)", chunks.select(F.lit("primary").alias("role"), "chunk_id", F.lit(None).cast("string").alias("name")).filter("false")
    none = F.lit(None).cast(chunks.schema["chunk_id"].dataType)
    primary = structural.first_chunk(defs, chunks).select("chunk_id").distinct()
    out = primary.select(F.lit("primary").alias("role"), "chunk_id", F.lit(None).cast("string").alias("name"))
    out = out.unionByName(defs.select(F.lit("definition").alias("role"), none.alias("chunk_id"), F.col("qualified_name").alias("name")))
    if callers:
        places = structural.find_references(refs, symbol).select(F.col("from_file").alias("file_path"), "line").orderBy("file_path", "line").limit(limit)
        out = out.unionByName(_around(places, chunks, "caller", primary))
    return f"symbol: {symbol}", out
