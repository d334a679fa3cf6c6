"""Incremental variants over Structured Streaming.

History keeps one row of facts per commit and path, and decays at query time from the events' own times; so a stream that has
seen the same commits gives the same tables as a batch, whatever the order and size of its batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, structural
from ..sinks import index
from ..sinks.versions import GRACE_SECONDS, Store


def stream_changes(kept: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends a stream of kept file changes (commit_id, path, added, deleted, ts, is_fix) to a table of facts at path."""
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def history_of(facts: DataFrame, now: int) -> DataFrame:
    """The history table of the facts so far; a commit delivered twice counts once."""
    return history.file_history(facts.dropDuplicates(["commit_id", "path"]), now)


def stream_file_index(files: DataFrame, path: str, checkpoint: str, *, most_segments: int = 32, keep: int = 2, grace: float = GRACE_SECONDS, **trigger):
    """Keeps a table of files at path in step with a stream of (path, language, content_hash, indexed_at) rows, the last of each path.

    A batch writes its own rows as one version of a store (``sinks.versions``), so a reader sees all of it or nothing, at any time, and a batch that is
    delivered again changes nothing. Beyond ``most_segments`` the segments are folded into one, and what no reader may hold any more goes.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path)
        if store.open().state.get("stream_batch", -1) >= number:
            return
        new = structural.latest(batch, "path", "indexed_at")
        b = store.begin(lease=0.0)  # the stream's checkpoint admits one writer
        new = b.put("files", new)
        b.put("touched", new.select("path", F.lit(False).alias("gone")))
        done = b.commit(stream_batch=number)
        if len(done.tables["files"]["segments"]) > most_segments:
            index.compacted(store)
            store.vacuum(keep=keep, grace=grace)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark, path: str) -> DataFrame | None:
    """The table that the stream has kept so far; None before its first batch."""
    last = Store(spark, path).open()
    return index.live(last, "files").drop("segment") if last.has("files") else None


def event_windows(events: DataFrame, *, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts of events by window and type; rows later than ``late`` are dropped once their window is closed."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_sessions(events: DataFrame, *, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def once(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
