"""The structural and the semantic index of a project, as commits of several tables.

Tables hold one segment a batch. ``touched`` lists the paths of each later batch, and whether they went; rows of a path that came before are dead.
So a batch writes what changed and nothing else, one path costs the same whatever the size of the index, and ``compacted`` folds the segments
into one. The order in which batches are applied is that of their commits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inverted, structural
from ..sources import chunker, extractors
from ..sources.gitlog import resolved_mode
from .versions import Batch, Snapshot, Store, rows_of

#: The columns of each table that name a path, and whether a changed path kills its rows or only one that is gone.
KEYS = {"files": (("path",), True), "symbols": (("file_path",), True), "refs": (("from_file",), True), "chunks": (("file_path",), True), "history": (("path",), False), "pairs": (("file_a", "file_b"), False)}
BY_FILE = ("files", "symbols", "refs", "chunks")


def live(snapshot: Snapshot, name: str) -> DataFrame:
    """The rows of a table that no later batch has replaced or removed, with their segment."""
    df = snapshot.table(name)
    if not snapshot.has("touched") or name not in KEYS:
        return df
    columns, changes = KEYS[name]
    touched = snapshot.table("touched")
    last = (touched if changes else touched.filter("gone")).groupBy("path").agg(F.max("segment").alias("_last"))
    for c in columns:
        df = df.join(last.withColumnRenamed("path", c), c, "left").filter("_last IS NULL OR segment >= _last").drop("_last")
    return df


def postings(snapshot: Snapshot) -> inverted.Postings:
    """The inverted index of a version."""
    dead = snapshot.table("dead").select("key", F.col("of_segment").alias("segment")) if snapshot.has("dead") else None
    return inverted.Postings(snapshot.table("postings"), snapshot.state.get("chunks", 0), snapshot.state.get("words", 0), snapshot.state["buckets"], dead)


def put_chunks(batch: Batch, chunks: DataFrame, *, whole: bool, touched: DataFrame | None = None, key: str = "chunk_id") -> dict:
    """Writes chunks (key, file_path, language, content, ...) and their postings. Returns the state to commit.

    ``whole`` replaces all earlier chunks; else those of the touched paths die. Keys must differ between live chunks.
    """
    n, words = 0, 0
    if not whole and touched is not None and batch.base.has("chunks"):
        gone = live(batch.base, "chunks").join(touched.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        dead = batch.put("dead", gone.select(F.col(key).alias("key"), F.col("segment").alias("of_segment"), "words"))
        lost = dead.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
        n, words = batch.base.state["chunks"] - lost[0], batch.base.state["words"] - lost[1]
    if whole:
        batch.drop("dead")
    added = batch.put("chunks", chunks.withColumn("words", F.size(inverted.words_of(F.col("content"))).cast("bigint")), replace=whole)
    more = added.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    buckets = inverted.buckets_for(more[0]) if whole or not batch.base.has("postings") else batch.base.state["buckets"]
    batch.put("postings", inverted.blocks(added, more[0], buckets, key=key), "bucket", replace=whole)
    return {"chunks": n + more[0], "words": words + more[1], "buckets": buckets}


def chunks_of(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """chunk_id, file_path, language, content, start_line and end_line; the id is the path and the first byte."""
    as_text = files.withColumn("content", F.col("content").cast("string"))
    x = chunker.chunked(as_text).withColumn("chunk_id", F.concat("file_path", F.lit("#"), F.col("start_byte").cast("string")))
    x = x if symbols is None else structural.with_headers(x, symbols)
    return x.select("chunk_id", "file_path", "language", "content", "start_line", "end_line")


def index_files(store: Store, files: DataFrame, *, mode: str = "auto", head: str | None = None, is_ancestor: bool = True, semantic: bool = True, embed: Callable[[DataFrame], DataFrame] | None = None, lease: float | None = None) -> Snapshot:
    """Brings the index of a project in step with its files (path, language, content_hash, content) in one commit.

    mode is full, incremental or auto (``resolved_mode``). Files whose hash is unchanged are skipped unless all are asked for, files that are gone take their
    symbols, references, chunks, history and pairs along. embed adds an ``embedding`` column to chunks. Without a head commit an
    auto run is incremental where there is an index. The state of the new version holds the run's figures under ``run``.
    """
    batch = store.begin(**({} if lease is None else {"lease": lease}))
    try:
        return _index_files(batch, files, mode, head, is_ancestor, semantic, embed)
    except Exception:
        batch.abort()
        raise


def _index_files(batch: Batch, files: DataFrame, mode: str, head: str | None, is_ancestor: bool, semantic: bool, embed) -> Snapshot:
    base, known = batch.base, batch.base.has("files")
    if head is None and mode == "auto":
        what = "incremental" if known else "full"
    else:
        what = resolved_mode(mode, head or "", base.state.get("head") if known else None, is_ancestor)
    if what == "none":
        batch.abort()
        return base
    whole = what == "full" or not known
    found = files.select("path", "language", "content_hash")
    stored = live(base, "files").select("path", "content_hash") if known else None
    changed = found if whole else structural.changed(found, stored)
    touched = changed.select("path", F.lit(False).alias("gone"))
    if stored is not None:
        touched = touched.unionByName(structural.orphans(stored, found).select("path", F.lit(True).alias("gone")))
    # what changed is settled once; all other tables follow from it
    touched = batch.put("touched", touched, replace=False)
    now = touched.filter("NOT gone").select("path")
    content = files.join(now, "path", "left_semi")
    batch.put("files", found.join(now, "path", "left_semi"), replace=whole)
    symbols = batch.put("symbols", extractors.symbols(content), replace=whole)
    refs = batch.put("refs", extractors.references(content), replace=whole)
    state = {"head": head}
    if semantic:
        cut = chunks_of(content, symbols)
        state |= put_chunks(batch, cut if embed is None else embed(cut), whole=whole, touched=touched)
    counted = touched.agg(F.count_if(~F.col("gone")), F.count_if("gone")).first()
    run = {"mode": what, "files_indexed": counted[0], "files_removed": counted[1], "files_skipped": found.count() - counted[0], "symbols_found": symbols.count(), "references_found": refs.count()}
    return batch.commit(**state, run=run)


def put_history(store: Store, history: DataFrame, pairs: DataFrame, *, head: str | None = None) -> Snapshot:
    """Replaces the history tables (an additive update is ``merge_pairs`` and ``merge_history`` of the live tables and the new commits)."""
    batch = store.begin()
    try:
        batch.put("history", history, replace=True)
        batch.put("pairs", pairs, replace=True)
        return batch.commit(history_head=head)
    except Exception:
        batch.abort()
        raise


def clear_history(store: Store) -> Snapshot:
    batch = store.begin()
    batch.drop("history", "pairs")
    return batch.commit(history_head=None)


def compacted(store: Store, *, files_each: int = 16) -> Snapshot:
    """Folds all segments into one of live rows, in few files; nothing else changes. Readers of earlier versions keep what they have until a vacuum."""
    batch = store.begin()
    try:
        base, state = batch.base, {}
        for name in [n for n in KEYS if base.has(n) and n != "chunks"]:
            batch.put(name, live(base, name).drop("segment").coalesce(files_each), replace=True)
        if base.has("chunks"):
            state = put_chunks(batch, live(base, "chunks").drop("segment", "words"), whole=True)
        batch.drop("touched")
        return batch.commit(**state)
    except Exception:
        batch.abort()
        raise


def cleanup(store: Store, keep: str, *, prefix: str = "chunks_", dry_run: bool = False) -> list[str]:
    """Drops the tables of other embedding models than the one to keep (``names.model_table_name``); lists them only, if dry_run. A vacuum frees their space."""
    gone = [n for n in store.open().names() if n.startswith(prefix) and n != keep]
    if gone and not dry_run:
        batch = store.begin()
        batch.drop(*gone)
        batch.commit()
    return gone


def status(snapshot: Snapshot) -> DataFrame:
    """(table_name, n) of live rows, 0 for tables that are not there."""
    parts = [live(snapshot, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") if snapshot.has(n) else rows_of(snapshot, [n]) for n in KEYS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream_files(files: DataFrame, store: Store, checkpoint: str, **trigger):
    """Applies a stream of (path, language, content_hash, content, indexed_at, gone) to an index; the last row of a path counts.

    A batch that is delivered again is recognised by its number in the state and leaves the index as it is.
    """

    def merge(rows: DataFrame, number: int) -> None:
        if store.open().state.get("stream_batch", -1) >= number:
            return
        rows = structural.latest(rows, "path", "indexed_at")
        batch = store.begin(lease=0.0)  # the stream's checkpoint admits one writer
        touched = batch.put("touched", rows.select("path", F.coalesce("gone", F.lit(False)).alias("gone")))
        content = rows.join(touched.filter("NOT gone").select("path"), "path", "left_semi")
        batch.put("files", content.select("path", "language", "content_hash"))
        symbols = batch.put("symbols", extractors.symbols(content))
        batch.put("refs", extractors.references(content))
        state = put_chunks(batch, chunks_of(content, symbols), whole=False, touched=touched)
        batch.commit(**state, stream_batch=number)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
