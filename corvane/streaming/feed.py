"""Structured Streaming over feeds of rows: late data by overlap, idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import merging
from corvane.sources.store import Merged, Store


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of columns; a struct maximum, combined map-side."""
    rest = [c for c in rows.columns if c not in (*key, *order)]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(*key, "r.*").select(rows.columns)


def deduped(stream: DataFrame, key: list[str], at: str, overlap: str = "7 days") -> DataFrame:
    """Rows whose key wasn't seen within the overlap; state is dropped behind the watermark."""
    return stream.withWatermark(at, overlap).dropDuplicatesWithinWatermark(key)


def upsert_stream(stream: DataFrame, store: Store, table: str, key: list[str], order: list[str], checkpoint: str, merge: Callable = merging.overwrite, feed: str = "feed") -> StreamingQuery:
    """Upsert each micro-batch into a stored table, whose buckets without a key of the batch stay as they are.
    A batch that is replayed is known by its tag and changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        tag = (feed, number)
        if store.committed(tag):
            return
        store.commit({table: Merged(latest(batch, key, order), key, merge)}, tag)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(batch: DataFrame, stored: DataFrame, key: str = "case_key") -> DataFrame:
    """One row of what a batch does: read, rejected, inserted, updated, repeated rows."""
    good = batch.where(F.col(key).isNotNull())
    keys = good.groupBy(key).agg(F.count("*").alias("n"))
    marked = keys.join(stored.select(key).distinct().withColumn("__old", F.lit(True)), key, "left")
    done = marked.agg(F.count_if("__old").alias("updated"), F.count_if(F.col("__old").isNull()).alias("inserted"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    seen = batch.agg(F.count("*").alias("read"), F.count_if(F.col(key).isNull()).alias("rejected"))
    return seen.crossJoin(F.broadcast(done))  # one row each
