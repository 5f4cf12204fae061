"""Synchronisation of a case index with a paged source: windows, dedupe, upsert, checkpoints.

Each window is one commit of cases, children, details, the stream's checkpoint and the run's
audit row, with a tag: one that was committed changes nothing. A window that fails leaves an audit
row and its dates with the stream's failures, in a commit of their own; the next run begins with that
window. Only completed windows move the checkpoint. A window's pages are read once: its typed records are
written beside the store before they are merged, counted as they are written, and deleted after the commit.
"""

from __future__ import annotations

import datetime as dt
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators import merging, normalizing
from corvane.sources import pages
from corvane.sources.store import Added, Merged, Store

_CASE = [f.split()[0] for f in schemas.SCHEMAS["cases_index"].split(", ")]
_CHILDREN = {"parties": "parties", "case_events": "events", "case_findings": "findings", "case_airports": "airports"}


def hydrate(rows: DataFrame, backend, partitions: int = 5) -> DataFrame:
    """(ordinal, payload) with each record's full payload from the source; a failure keeps the summary.

    As many requests run at once as there are partitions.
    """

    def run(batches):
        import json

        for batch in batches:
            out = []
            for record, key in zip(batch["payload"], batch["case_key"], strict=True):
                try:
                    body = pages.fetch(backend, "one", {"case_key": key})
                    out.append(json.dumps(body) if body is not None else record)
                except Exception:  # the summary stands in for a detail that can't be had
                    out.append(record)
            yield pd.DataFrame({"ordinal": batch["ordinal"], "payload": out})

    return rows.select("ordinal", F.col("record").alias("payload"), "case_key").repartition(partitions).mapInPandas(run, "ordinal long, payload string")


def checkpoint(store: Store, stream: str) -> dt.date | None:
    """The last day of the stream's completed windows."""
    if not store.has("sync_checkpoints"):
        return None
    row = store.read("sync_checkpoints").where(F.col("stream") == stream).agg(F.max("window_end")).first()
    return row[0]


def failed_window(store: Store, stream: str) -> tuple[dt.date, dt.date] | None:
    """The window in which the stream's last run failed, if it hasn't been completed since."""
    if not store.has("sync_failures"):
        return None
    row = store.read("sync_failures").where(F.col("stream") == stream).first()
    return (row.window_start, row.window_end) if row else None


def record_failure(store: Store, stream: str, start: dt.date, end: dt.date, now: str, error: Exception) -> None:
    """Keep what failed and why; rows of cases stay as they were."""
    spark, stamp = store.spark, F.lit(now).cast("timestamp")
    row = spark.createDataFrame([(f"{stream}:{start}:{end}:{now}", stream, "failed", 0, 0, 0, 0, 0, str(error)[:500])], "run_id string, stream string, status string, read long, rejected long, inserted long, updated long, repeated long, error string")
    mark = _fit(spark.createDataFrame([(stream, start, end, "failed")], "stream string, window_start date, window_end date, status string").withColumn("updated_at", stamp), "sync_checkpoints")
    row = _fit(row.withColumns({"started_at": stamp, "ended_at": stamp}), "sync_runs")
    store.commit({
        "sync_runs": Added(row),
        "sync_failures": Merged(mark, ["stream"], merging.overwrite),
    })


def _fit(rows: DataFrame, table: str) -> DataFrame:
    out = []
    for f in schemas.SCHEMAS[table].split(", "):
        name, kind = f.split(" ", 1)
        out.append(F.col(name).cast(kind).alias(name) if name in rows.columns else F.lit(None).cast(kind).alias(name))
    return rows.select(out)


def apply_window(store: Store, payloads: DataFrame, stream: str, start: dt.date, end: dt.date, now: str, skip_known: bool = False, backend=None) -> dict:
    """Merge one window's pages (ordinal, payload) and commit it; returns its counts."""
    spark = payloads.sparkSession
    tag = f"{stream}:{start}:{end}:{now}"
    typed = normalizing.cases(normalizing.records(payloads))
    if backend is not None:
        typed = normalizing.cases(normalizing.records(hydrate(normalizing.accepted(typed), backend)))
    staged = f"{store.path}/_staged/{uuid.uuid4().hex}"
    try:
        read, kept = Observation(), Observation()
        typed.observe(read, F.count("*").alias("read"), F.count_if(F.col("case_key").isNull()).alias("rejected")).write.parquet(f"{staged}/typed")
        typed = spark.read.schema(typed.schema).parquet(f"{staged}/typed")
        good, _ = merging.claims_in_rounds(normalizing.accepted(typed), "ordinal")
        old = store.read("cases_index") if store.has("cases_index") else schemas.empty(spark, "cases_index")
        good = merging.unseen(good, old) if skip_known else merging.without_conflicts(good, old)
        known = old.select("case_key", F.lit(True).alias("__known"))  # one row a case
        marked = good.join(known, "case_key", "left").observe(kept, F.count("*").alias("kept"), F.count("__known").alias("updated"))
        marked.select(good.columns).write.parquet(f"{staged}/good")
        good = spark.read.schema(good.schema).parquet(f"{staged}/good")
        stamp = F.lit(now).cast("timestamp")
        fresh = _fit(good.withColumn("synced_at", stamp), "cases_index")
        key = ["case_key"]
        changed = {"cases_index": Merged(fresh, key, lambda kept, new, by: merging.fill(kept, new, by, "synced_at", stamp))}
        for table, field in _CHILDREN.items():
            changed[table] = Merged(_fit(normalizing.children(good, field), table), key, lambda kept, new, by: merging.replace_children(kept, new))
        changed["detail_cache"] = Merged(_fit(good.select("case_key", F.col("record").alias("payload"), "hash", stamp.alias("fetched_at")), "detail_cache"), key, merging.overwrite)
        n = read.get | kept.get
        counts = {"read": n["read"], "rejected": n["rejected"], "inserted": n["kept"] - n["updated"], "updated": n["updated"], "repeated": n["read"] - n["rejected"] - n["kept"]}
        mark = spark.createDataFrame([(stream, start, end, "completed")], "stream string, window_start date, window_end date, status string").withColumn("updated_at", stamp)
        row = spark.createDataFrame([(tag, stream, "completed", *counts.values())], "run_id string, stream string, status string, read long, rejected long, inserted long, updated long, repeated long").withColumns({"started_at": stamp, "ended_at": stamp})
        changed["sync_checkpoints"] = Merged(_fit(mark, "sync_checkpoints"), ["stream"], merging.overwrite)
        if failed_window(store, stream):
            changed["sync_failures"] = store.read("sync_failures").where(F.col("stream") != stream)
        changed["sync_runs"] = Added(_fit(row, "sync_runs"))
        store.commit(changed, tag)
        return counts
    finally:
        store.delete(staged)


def run(spark: SparkSession, store: Store, backend, stream: str, start: dt.date, today: dt.date, now: str, incremental: bool = True, days: int = pages.WINDOW_DAYS, refresh: bool = True) -> list[dict]:
    """Bring the index up to today: one overlapping window if incremental, else windows of `days` after the checkpoint."""
    spark.dataSource.register(pages.source_of(backend))
    span = pages.next_window(checkpoint(store, stream), failed_window(store, stream), today, incremental, start)
    out = []
    for a, b in ([span] if incremental and span else pages.windows(*span, days) if span else []):
        kind = "by_modified" if incremental else "by_date"
        read = pages.read(spark, a, b, kind, days)
        place = F.datediff("window_start", F.lit(a.isoformat()).cast("date")).cast("long") * 1_000_000 + F.col("page")
        try:
            out.append(apply_window(store, read.select(place.alias("ordinal"), "payload"), stream, a, b, now, skip_known=not incremental and not refresh))
        except Exception as error:
            record_failure(store, stream, a, b, now, error)
            raise
    return out
