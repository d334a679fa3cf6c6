"""A log of records that is appended to and bounded: once a key, and cut to its newest records when it has grown too long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import Snapshot, Store

# fixed values: the size at which a log is cut, and how many records it keeps
LONGEST_BYTES, KEPT_RECORDS = 1 << 20, 10_000


def append(store: Store, records: DataFrame, *, once: Sequence[str] = (), at: str = "at", longest_bytes: int = LONGEST_BYTES, kept: int = KEPT_RECORDS) -> Snapshot:
    """Adds records to the store's log. Of records that agree in the columns ``once`` only the first in time is kept, and none where the log has one.

    Beyond longest_bytes (as JSON lines) only the newest records stay, by ``at`` and then by all columns. Without anything new the version stays.
    """
    batch = store.begin()
    try:
        base = batch.base
        fresh = records
        if once:
            fresh = fresh.groupBy(*once).agg(F.min_by(F.struct(*[F.col(c) for c in records.columns]), F.struct(at, *records.columns)).alias("r")).select("r.*")
            if base.has("log"):
                fresh = fresh.join(base.table("log").select(*once), list(once), "left_anti")
        added = batch.put("log", fresh.select(*records.columns))
        n, size = added.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1), F.lit(0))).first()
        if not n:
            batch.abort()
            return base
        size += base.state.get("log_bytes", 0)
        if size > longest_bytes:
            whole = added if not base.has("log") else base.table("log").select(*records.columns).unionByName(added)
            left = batch.put("log", whole.orderBy(F.desc(at), *[F.desc(c) for c in records.columns]).limit(kept), replace=True)
            size = left.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1), F.lit(0))).first()[0]
        return batch.commit(log_bytes=size)
    except Exception:
        batch.abort()
        raise
