"""Report queries over evaluation tables.

Tables: datasets, cases, runs, case_runs, metrics, evidence, retrieved_items, context_items. Each
report aggregates the large side (case_runs, metrics) by run before it joins runs, so one
shuffle of partial sums is all that grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import measures as M
from corvane.operators import selection

#: Dimension name to expression; no other is accepted.
DIMENSIONS = {
    "category": lambda: F.col("category"), "aircraft": lambda: F.coalesce("aircraft", F.lit("Unknown")), "variant": lambda: F.coalesce("variant", F.lit("Unknown")),
    "difficulty": lambda: F.col("difficulty"), "split": lambda: F.col("split"), "answerable": lambda: F.col("answerable").cast("string"),
}
RESOURCES = (
    ("p50 latency", "p50_latency_ms", "milliseconds"), ("p95 latency", "p95_latency_ms", "milliseconds"), ("Average latency", "avg_latency_ms", "milliseconds"),
    ("Retrieved tokens", "retrieved_tokens", "tokens"), ("Context tokens", "context_tokens", "tokens"), ("Input tokens", "input_tokens", "tokens"),
    ("Output tokens", "output_tokens", "tokens"), ("Known cost", "known_cost", "currency"),
)
CONCEPTS = ("recall", "mrr", "ndcg", "hit_rate", "precision", *M.EFFICIENCY)


def require_public(name: str) -> str:
    import re

    if name not in M.PUBLIC and not re.match(M.AT_CUT, name):
        raise ValueError("Unsupported public metric")
    return name


def consensus(value: Column) -> Column:
    """The value all rows agree on, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def expected_cases(cases: DataFrame) -> DataFrame:
    return cases.where("status <> 'rejected'").groupBy("dataset_id").agg(F.count("*").alias("expected_cases"))


def list_datasets(datasets: DataFrame, cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Datasets with numbers of cases and runs, latest activity first."""
    counted = expected_cases(cases).withColumnRenamed("expected_cases", "case_count")
    ran = runs.groupBy("dataset_id").agg(F.count("*").alias("run_count"), F.max("started_at").alias("latest_run_at"))
    out = datasets.join(counted, "dataset_id", "left").join(ran, "dataset_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("case_count", "run_count")})
    return out.orderBy(F.desc_nulls_last(F.coalesce("latest_run_at", "created_at")), "dataset_id")


def case_stats(case_runs: DataFrame, buffer: int = selection.BUFFER) -> DataFrame:
    """All per-run figures of case_runs in one aggregation; where a run has more than `buffer` latencies, their percentiles by selection."""
    if selection.large_groups(case_runs, "run_id", "latency_ms", buffer).isEmpty():
        return _case_stats(case_runs, lambda p: F.percentile(F.col("latency_ms").cast("double"), p))
    exact = selection.percentiles(case_runs, "run_id", "latency_ms", [0.5, 0.95], ["p50_latency_ms", "p95_latency_ms"], buffer).withColumnRenamed("run_id", "__run")
    rest = _case_stats(case_runs, lambda p: F.lit(None).cast("double"))
    met = rest.drop("p50_latency_ms", "p95_latency_ms").join(exact, F.col("run_id").eqNullSafe(F.col("__run")), "left")
    return met.select(*rest.columns)


def _case_stats(case_runs: DataFrame, at) -> DataFrame:
    return case_runs.groupBy("run_id").agg(
        F.count("*").alias("executed_cases"), F.count_if("abstained").alias("abstained_cases"), F.avg("latency_ms").alias("avg_latency_ms"),
        at(0.5).alias("p50_latency_ms"), at(0.95).alias("p95_latency_ms"), F.sum("latency_ms").alias("total_latency_ms_cases"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("context_tokens").alias("context_tokens"),
        F.sum("estimated_cost").alias("known_cost"), F.count("estimated_cost").alias("cost_samples"),
        consensus(F.get_json_object("raw_output", "$.metadata.top_k").try_cast("int")).alias("raw_top_k"),
    )


def list_runs(runs: DataFrame, cases: DataFrame, case_runs: DataFrame, datasets: DataFrame | None = None, dataset_id=None) -> DataFrame:
    """Runs with expected and executed cases, mean latency and top_k, newest first."""
    if dataset_id is not None:
        runs = runs.where(F.col("dataset_id") == dataset_id)
    stats = case_runs.groupBy("run_id").agg(F.count("*").alias("executed_cases"), F.avg("latency_ms").alias("avg_latency_ms"), consensus(F.get_json_object("raw_output", "$.metadata.top_k").try_cast("int")).alias("raw_top_k"))
    if datasets is not None:
        runs = runs.join(datasets.select("dataset_id", F.col("name").alias("dataset_name"), F.col("version").alias("dataset_version"), F.col("status").alias("dataset_status")), "dataset_id")
    out = runs.join(expected_cases(cases), "dataset_id", "left").join(stats, "run_id", "left")
    out = out.withColumns({"executed_cases": F.coalesce("executed_cases", F.lit(0)).cast("long"), "top_k": M.top_k(F.col("config"), F.col("raw_top_k")), "public_config": F.to_json(_kept("config", M.SHOWN_SETTINGS))})
    return out.drop("config").orderBy(F.desc_nulls_last("started_at"), "run_name", "run_id")


def _kept(column: str, allowed):
    from corvane.functions.values import kept_keys

    return kept_keys(F.col(column), list(allowed))


def run_summary(run_id, runs: DataFrame, cases: DataFrame, case_runs: DataFrame) -> DataFrame:
    """One run with all its figures; no row if there is none."""
    one = runs.where(F.col("run_id") == run_id)
    stats = case_stats(case_runs.where(F.col("run_id") == run_id))
    out = one.join(expected_cases(cases), "dataset_id", "left").join(stats, "run_id", "left")
    shown = {"top_k": M.top_k(F.col("config"), F.col("raw_top_k")), "public_config": F.to_json(_kept("config", M.SHOWN_SETTINGS)), "public_model_versions": F.to_json(_kept("model_versions", M.SHOWN_MODELS))}
    return out.withColumns(shown).drop("config", "model_versions")


def metric_summary(run_id, metrics: DataFrame) -> DataFrame:
    """Count, mean, least and greatest score of each public measure of a run."""
    rows = metrics.where((F.col("run_id") == run_id) & M.is_public(F.col("metric_name")) & M.judged(F.col("metric_name"), F.col("details")))
    out = rows.groupBy("metric_name", "evaluator_version").agg(F.count("*").alias("sample_count"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    return out.orderBy("metric_name", "evaluator_version")


def metric_history(dataset_id, name: str, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Mean score of a measure in each completed run of a dataset, oldest first."""
    rows = metrics.where((F.col("metric_name") == require_public(name)) & M.judged(F.col("metric_name"), F.col("details")))
    means = rows.groupBy("run_id").agg(F.avg("score").alias("mean_score"), F.count("*").alias("sample_count"))
    done = runs.where((F.col("dataset_id") == dataset_id) & (F.col("status") == "completed")).select("run_id", "run_name", "run_type", "status", "started_at")
    return done.join(means, "run_id").orderBy("started_at", "run_id")


def quality_latency(dataset_id, runs: DataFrame, case_runs: DataFrame, metrics: DataFrame, name: str = "mrr") -> DataFrame:
    """Mean score beside latency and tokens of each run of a dataset."""
    rows = metrics.where((F.col("metric_name") == require_public(name)) & M.judged(F.col("metric_name"), F.col("details")))
    means = rows.groupBy("run_id").agg(F.avg("score").alias("mean_score"), F.count("*").alias("metric_cases"))
    stats = case_stats(case_runs).select("run_id", "executed_cases", "avg_latency_ms", "p95_latency_ms", "input_tokens", "output_tokens")
    shown = runs.where(F.col("dataset_id") == dataset_id).select("run_id", "run_name", "run_type", "status", "started_at", "prompt_version", "corpus_version")
    return shown.join(means, "run_id").join(stats, "run_id", "left").orderBy("started_at", "run_id")


def paired(baseline, candidate, metrics: DataFrame) -> DataFrame:
    """Scores of two runs side by side, by case, measure and evaluator."""
    key = ["case_id", "metric_name", "evaluator_version"]
    side = lambda run, name: metrics.where((F.col("run_id") == run) & M.is_public(F.col("metric_name"))).select(*key, F.col("score").alias(name))
    return side(candidate, "candidate_score").join(side(baseline, "baseline_score"), key).withColumn("delta", F.col("candidate_score") - F.col("baseline_score"))


def compare_runs(baseline, candidate, metrics: DataFrame) -> DataFrame:
    """Paired means and deltas of each measure, with the delta's direction made positive for better."""
    rows = paired(baseline, candidate, metrics).groupBy("metric_name", "evaluator_version").agg(
        F.count("*").alias("paired_cases"), F.avg("baseline_score").alias("baseline_mean"), F.avg("candidate_score").alias("candidate_mean"),
        F.avg("delta").alias("mean_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"),
    )
    return rows.withColumn("normalized_delta", M.normalized_delta(F.col("metric_name"), F.col("mean_delta"))).orderBy("metric_name", "evaluator_version")


def breakdown(run_id, metrics: DataFrame, cases: DataFrame, dimension: str = "category", name: str = "mrr") -> DataFrame:
    """Mean score of a measure by one dimension of the cases, best first."""
    if dimension not in DIMENSIONS:
        raise ValueError("Unsupported breakdown dimension")
    rows = metrics.where((F.col("run_id") == run_id) & (F.col("metric_name") == require_public(name)) & M.judged(F.col("metric_name"), F.col("details")))
    joined = rows.select("case_id", "score").join(cases, "case_id").withColumn("dimension_value", DIMENSIONS[dimension]())
    out = joined.groupBy("dimension_value").agg(F.count("*").alias("sample_count"), F.avg("score").alias("mean_score"))
    return out.orderBy(F.desc_nulls_last("mean_score"), F.desc("sample_count"), "dimension_value")


def case_results(run_id, case_runs: DataFrame, cases: DataFrame, metrics: DataFrame, baseline=None, name: str = "mrr") -> DataFrame:
    """Each case of a run with its score and, by equal evaluator, the baseline's; worst change first, unpaired last."""
    require_public(name)
    mine = metrics.where((F.col("run_id") == run_id) & (F.col("metric_name") == name)).select("case_id", "evaluator_version", F.col("score").alias("candidate_score"))
    other = metrics.where((F.col("run_id") == baseline) & (F.col("metric_name") == name)) if baseline is not None else metrics.where(F.lit(False))
    other = other.select("case_id", "evaluator_version", F.col("score").alias("baseline_score"))
    shown = cases.select("case_id", "question", "answerable", "aircraft", "variant", "category", "difficulty", "split")
    rows = case_runs.where(F.col("run_id") == run_id).select("case_run_id", "run_id", "case_id", "abstained", "retrieved_count", "latency_ms").join(shown, "case_id")
    rows = rows.join(mine, "case_id", "left").join(other, ["case_id", "evaluator_version"], "left")
    rows = rows.withColumn("delta", F.col("candidate_score") - F.col("baseline_score")).withColumn("normalized_delta", M.normalized_delta(F.lit(name), F.col("delta"))).drop("evaluator_version")
    return rows.orderBy(F.when(F.col("baseline_score").isNull(), 1).otherwise(0), F.asc_nulls_last("delta"), "case_id")


def explore(results: DataFrame, category: str | None = None, aircraft: str | None = None, needle: str | None = None) -> DataFrame:
    """Case results narrowed by category, aircraft and a piece of id or question."""
    if category:
        results = results.where(F.col("category") == category)
    if aircraft:
        results = results.where(F.col("aircraft") == aircraft)
    if needle:
        results = results.where(F.contains(F.lower("case_id"), F.lit(needle.lower())) | F.contains(F.lower("question"), F.lit(needle.lower())))
    return results


def case_detail(run_id, case_id, case_runs: DataFrame, cases: DataFrame) -> DataFrame:
    wanted = case_runs.where((F.col("run_id") == run_id) & (F.col("case_id") == case_id)).drop("raw_output", "trace_id")
    return wanted.join(cases.drop("dataset_id", "status"), "case_id")


def case_metrics(run_id, case_id, metrics: DataFrame) -> DataFrame:
    rows = metrics.where((F.col("run_id") == run_id) & (F.col("case_id") == case_id) & M.is_public(F.col("metric_name")))
    return rows.select("metric_name", "score", "evaluator_version", "details").orderBy("metric_name", "evaluator_version")


def first_rows(rows: DataFrame, order: list, most: int = 20) -> DataFrame:
    """What a table shows of rows: the first ones in order."""
    return rows.orderBy(*order).limit(most)


def evidence_of(case_id, evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("case_id") == case_id).drop("case_id").orderBy(F.desc_nulls_last("relevance"), "evidence_id")


def retrieved_items(case_run_id, items: DataFrame) -> DataFrame:
    return items.where(F.col("case_run_id") == case_run_id).drop("case_run_id").orderBy("rank")


def context_items(case_run_id, items: DataFrame) -> DataFrame:
    return items.where(F.col("case_run_id") == case_run_id).drop("case_run_id").orderBy("position")


def concept_rows(baseline: DataFrame, candidate: DataFrame, baseline_k: int | None, candidate_k: int | None) -> DataFrame:
    """Each concept's measure at either run's own cut-off, from two metric summaries."""
    spark = baseline.sparkSession
    concepts = spark.createDataFrame([(i, c) for i, c in enumerate(CONCEPTS)], "ordinal int, concept string")
    at = lambda k: M.at_cut(F.col("concept"), F.lit(k).cast("int"))
    rows = concepts.withColumns({"baseline_metric_name": at(baseline_k), "candidate_metric_name": at(candidate_k)})
    side = lambda df, name: df.select(F.col("metric_name").alias(f"{name}_metric_name"), F.col("mean_score").alias(f"{name}_mean"), F.col("sample_count").alias(f"{name}_samples"))
    rows = rows.join(side(baseline, "baseline"), "baseline_metric_name", "left").join(side(candidate, "candidate"), "candidate_metric_name", "left")
    mine, theirs = M.label(F.col("candidate_metric_name")), M.label(F.col("baseline_metric_name"))
    label = F.when(F.col("candidate_metric_name") == F.col("baseline_metric_name"), mine).otherwise(F.concat(mine, F.lit(" vs "), theirs))
    delta = F.col("candidate_mean") - F.col("baseline_mean")
    return rows.withColumns({"label": label, "delta": delta, "normalized_delta": M.normalized_delta(F.col("candidate_metric_name"), delta)}).orderBy("ordinal")


def _wide_to_long(wide: DataFrame, names: list[str], value: str) -> DataFrame:
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias(value)) for n in names])).alias("x")).select("x.*")


def resource_rows(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Eight measures of two one-row summaries with delta; lower is better, retrieved tokens neither."""
    names = [k for _, k, _ in RESOURCES]
    rows = _wide_to_long(candidate, names, "candidate").join(_wide_to_long(baseline, names, "baseline"), "key")
    known = baseline.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(RESOURCES)], "ordinal int, label string, key string, unit string")
    delta = F.col("candidate") - F.col("baseline")
    normalized = F.when(F.col("key") != "retrieved_tokens", -delta)
    return known.join(rows, "key").withColumns({"delta": delta, "normalized_delta": normalized}).orderBy("ordinal")


def field_rows(baseline: DataFrame, candidate: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Settings of two one-row summaries side by side, same or not; two unknowns are the same."""
    pick = lambda df, name: df.select(F.posexplode(F.array(*[F.struct(F.lit(label).alias("field"), F.col(c).cast("string").alias(name)) for label, c in fields])).alias("ordinal", "x")).select("ordinal", "x.*")
    rows = pick(candidate, "evaluation_a").join(pick(baseline, "evaluation_b").drop("field"), "ordinal")
    return rows.withColumn("same", F.when(F.col("evaluation_a").eqNullSafe(F.col("evaluation_b")), "yes").otherwise("no")).orderBy("ordinal")


def delta_histogram(rows: DataFrame, bins: int = 18, column: str = "delta") -> DataFrame:
    """(bin, n) of a column over equal widths between its extremes, at most `bins`; one bin if all are equal."""
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("d"))
    ends = known.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    placed = known.crossJoin(F.broadcast(ends))  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("d") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))).otherwise(0)
    return placed.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def movers(results: DataFrame, n: int = 12) -> DataFrame:
    """The cases whose score changed most either way."""
    return results.where("delta is not null").orderBy(F.desc(F.abs("delta")), "case_id").limit(n)


def default_run(runs: DataFrame) -> DataFrame:
    """The run shown first: the newest completed one that is no baseline, else completed, else any."""
    done, base = F.col("status") == "completed", F.col("run_type") == "baseline"
    return runs.orderBy(F.when(done & ~base, 0).when(done, 1).otherwise(2), F.desc_nulls_last("started_at"), "run_id").limit(1)


def recommended_baseline(runs: DataFrame, run_id, dataset_id) -> DataFrame:
    """The run to compare with: of the same dataset, not itself; completed baseline, else completed, else any."""
    others = runs.where((F.col("dataset_id") == dataset_id) & (F.col("run_id") != run_id))
    done, base = F.col("status") == "completed", F.col("run_type") == "baseline"
    return others.orderBy(F.when(done & base, 0).when(done, 1).otherwise(2), F.desc_nulls_last("started_at"), "run_id").limit(1)
