"""Writes from a stream: each micro-batch becomes a run of the stored log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tephra.sources.store import KeyValueStore


def put_stream(rows: DataFrame, store: KeyValueStore, checkpoint: str, order: str = "seq", **trigger) -> StreamingQuery:
    """Writes (key, value, `order` and perhaps is_deleted) as they come; the greatest `order` of a key wins, in whatever
    batch it comes.

    `order` becomes the rows' seq, so a batch that is run again after a failure, even
    after other writes, and rows that come late leave newer versions as they are.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.put_all(batch, order)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Newest version of each key as a running aggregate over (key, value, seq, is_deleted, ts); use update or complete mode."""
    newest = F.max_by(F.struct("value", "is_deleted", "seq"), "seq")
    return rows.withWatermark("ts", delay).groupBy("key").agg(newest.alias("v")).select("key", "v.value", "v.seq", "v.is_deleted")
