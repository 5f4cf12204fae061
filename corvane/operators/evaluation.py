"""Evaluation runs: one set-oriented job over all cases, stored with one commit.

A run is committed as running, then its case rows and totals in one commit as completed; on an
error only its state becomes failed, so no half of a run is ever visible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane import schemas
from corvane.operators import metrics as M
from corvane.sources.store import Added, Store

EVALUATOR = "v1"


def _fit(name: str, rows: DataFrame) -> DataFrame:
    out = []
    for f in schemas.SCHEMAS[name].split(", "):
        column, kind = f.split(" ", 1)
        out.append((F.col(column) if column in rows.columns else F.lit(None)).cast(kind).alias(column))
    return rows.select(out)


def totals(case_runs: DataFrame) -> DataFrame:
    """One row: total cost and latency, zero where nothing is known."""
    return case_runs.agg(F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("total_cost"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("total_latency_ms"))


def executed_matches(configured: int | None, items: DataFrame) -> bool:
    """Whether no case retrieved more items than configured."""
    if configured is None:
        return True
    return items.groupBy("case_id").count().where(F.col("count") > configured).isEmpty()


def run(store: Store, run_id: str, dataset_id: str, config: dict, cases: DataFrame, evidence: DataFrame, target: Callable[[DataFrame], tuple[DataFrame, ...]], started_at) -> DataFrame:
    """Evaluate target over the cases of a data set that aren't rejected; returns the stored measures of the run.

    target(cases) gives answers (case_id, answer, latency_ms, ...) and ranked items (case_id, rank,
    item_id, parent_id, token_count, ...), and may give the items of each answer's context (case_id,
    position, parent_id, source_file, token_count). Rows of a run are added; none of another run is read or written.
    """
    spark = cases.sparkSession
    import json

    cuts = M.cuts_for(config)
    head = spark.createDataFrame([(run_id, dataset_id, config.get("run_name", run_id), "experiment", json.dumps(config), "running")], "run_id string, dataset_id string, run_name string, run_type string, config string, status string").withColumn("started_at", F.lit(started_at).cast("timestamp"))
    store.commit({"runs": Added(_fit("runs", head))}, f"{run_id}:start")
    try:
        chosen = cases.where((F.col("dataset_id") == dataset_id) & (F.col("status") != "rejected"))
        answers, items, *context = target(chosen)
        if not executed_matches(config.get("top_k"), items):
            raise ValueError("configured and executed top_k differ")
        judged = M.qrels(evidence.join(chosen.select("case_id"), "case_id", "left_semi"))
        if not judged.isEmpty() and items.where("item_id is not null").isEmpty() and not items.isEmpty():
            raise ValueError("retrieved items need ids where judgements exist")
        scores = M.evaluate(items, judged, cuts, cases=chosen.select("case_id"))
        counted = judged.groupBy("case_id").agg(F.count("*").alias("n"))
        key = F.xxhash64(F.lit(run_id), "case_id")
        details = F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias("qrels_count"), F.lit(M.THRESHOLD).alias("relevance_threshold"), F.lit(list(cuts)).alias("k_values")))
        measured = scores.join(counted, "case_id", "left").select(key.alias("case_run_id"), F.lit(run_id).alias("run_id"), "case_id", "metric_name", "score", details.alias("details"), F.lit(EVALUATOR).alias("evaluator_version"))
        counts = items.groupBy("case_id").agg(F.count("*").alias("retrieved_count"))
        rows = chosen.select("case_id").join(answers, "case_id", "left").join(counts, "case_id", "left").withColumns({"case_run_id": key, "run_id": F.lit(run_id), "retrieved_count": F.coalesce("retrieved_count", F.lit(0))})
        known = items.join(judged, ["case_id", "item_id"], "left")
        known = known.withColumns({"case_run_id": key, "document_id": F.col("item_id"), "is_duplicate": F.row_number().over(_by_item()) > 1})
        sums = totals(_appended_columns(rows)).first()
        done = store.read("runs").withColumns({
            "status": F.when(F.col("run_id") == run_id, "completed").otherwise(F.col("status")), "total_cost": F.when(F.col("run_id") == run_id, F.lit(float(sums[0]))).otherwise(F.col("total_cost")),
            "total_latency_ms": F.when(F.col("run_id") == run_id, F.lit(float(sums[1]))).otherwise(F.col("total_latency_ms")),
        })
        more = {"case_runs": rows, "retrieved_items": known, "metrics": measured}
        if context:
            kept = context[0].join(chosen.select("case_id"), "case_id", "left_semi")
            more["context_items"] = kept.withColumns({"case_run_id": key, "selected": F.lit(True)})
        store.commit({"runs": done, **{name: Added(_fit(name, new)) for name, new in more.items()}}, f"{run_id}:done")
    except Exception as error:
        failed = store.read("runs").withColumns({"error": F.when(F.col("run_id") == run_id, F.lit(str(error)[:500])).otherwise(F.col("error")), "status": F.when(F.col("run_id") == run_id, "failed").otherwise(F.col("status"))})
        store.commit({"runs": failed}, f"{run_id}:failed")
        raise
    return store.read("metrics").where(F.col("run_id") == run_id)


def _by_item():
    from pyspark.sql import Window as W

    return W.partitionBy("case_id", "item_id").orderBy("rank")


def _appended_columns(rows: DataFrame) -> DataFrame:
    for name in ("estimated_cost", "latency_ms"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    return rows
