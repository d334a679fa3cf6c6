"""Co-change facts from a stream of file changes.

A commit's changes may come in any order, in several batches and more than once. They are gathered in the state of their commit until the watermark
says that it is whole; then the guard on its size is applied and its pairs are emitted once, as facts with the commit's own
time. The fold over facts decays at query time, so a stream that has seen the same commits gives the table of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C
from ..functions import paths
from ..operators.history import decay

FACTS = "commit_id string, ts bigint, file_a string, file_b string"


class _Commits(StatefulProcessor):
    """State of a commit: its files (path to whether it is a test), and what it has come to."""

    def __init__(self, max_files: int, wait_ms: int, remember_ms: int):
        self.max_files, self.wait_ms, self.remember_ms = max_files, wait_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "path string", "test boolean")
        self.told = handle.getValueState("told", "ts bigint, n int, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        ts, n, done = self.told.get() if self.told.exists() else (None, 0, False)
        for batch in [] if done else rows:
            for path, test, at in zip(batch["path"], batch["test"], batch["ts"], strict=True):
                ts = int(at) if ts is None else max(ts, int(at))
                # beyond the guard the files don't matter any more, so no more than its number is held
                if n <= self.max_files and not self.files.containsKey((path,)):
                    self.files.updateValue((path,), (bool(test),))
                    n += 1
        if not done:
            if not self.told.exists():
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.wait_ms)
            self.told.update((ts, n, False))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        ts, n, done = self.told.get()
        if done:
            self.told.clear()
            return
        files = sorted((k[0], v[0]) for k, v in self.files.iterator()) if 2 <= n <= self.max_files else []
        self.files.clear()
        # what is told again later is known for a while
        self.told.update((ts, n, True))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.remember_ms)
        rows = [(key[0], ts, a, b) for i, (a, x) in enumerate(files) for b, y in files[i + 1 :] if not (x and y)]
        if rows:
            yield pd.DataFrame(rows, columns=["commit_id", "ts", "file_a", "file_b"])

    def close(self) -> None:
        pass


def pair_facts(kept: DataFrame, *, at: str = "seen_at", late: str = "1 hour", wait_seconds: int = 0, remember_seconds: int = 30 * 86400, max_files: int = C.MAX_FILES_PER_COMMIT) -> DataFrame:
    """A stream of (commit_id, ts, file_a, file_b), each pair of a commit once, from a stream of kept changes (commit_id, path, ts, and the time ``at`` they were seen).

    A commit is whole when the watermark (the latest ``at`` less ``late``) has gone ``wait_seconds`` beyond where it was when its first change came; changes that are told
    again within ``remember_seconds`` after that are ignored, as are changes older than the watermark. Needs the RocksDB state store.
    """
    x = kept.select("commit_id", "path", paths.is_test_like(F.col("path")).alias("test"), F.col("ts").cast("bigint").alias("ts"), F.col(at).cast("timestamp").alias("at"))
    x = x.filter("commit_id IS NOT NULL AND path IS NOT NULL AND ts IS NOT NULL").withWatermark("at", late)
    processor = _Commits(max_files, wait_seconds * 1000 + 1, remember_seconds * 1000)
    return x.groupBy("commit_id").transformWithStateInPandas(processor, FACTS, "append", "eventTime")


def stream_pairs(kept: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None, **more):
    """Appends the pair facts of a stream to a table at path."""
    return pair_facts(kept, **more).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def pairs_of(facts: DataFrame, now: int, *, min_count: int = 1) -> DataFrame:
    """The co-change table of the facts so far."""
    x = facts.groupBy("file_a", "file_b").agg(F.sum(decay(F.col("ts"), now)).alias("weight"), F.count("*").alias("count"), F.max("ts").alias("last_observed_at"))
    return x.filter(F.col("count") >= min_count)
