"""Queries on evaluation reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import measures as M
from corvane.operators import reports as R
from corvane.operators import selection
from corvane.plans import fixtures as X
from corvane.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_JUDGED = "(metric_name IN ('duplicate_ratio', 'retrieved_tokens') OR coalesce(qrels, 0) > 0)"
_NORM = "CASE WHEN metric_name = 'duplicate_ratio' THEN -{0} WHEN metric_name = 'retrieved_tokens' THEN NULL ELSE {0} END"
_STATS = """stats AS (SELECT run_id, count(*) AS executed_cases, count(*) FILTER (abstained) AS abstained_cases, avg(latency_ms) AS avg_latency_ms, percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50_latency_ms,
  percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_latency_ms, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(context_tokens) AS BIGINT) AS context_tokens,
  sum(estimated_cost) AS known_cost, count(estimated_cost) AS cost_samples, CASE WHEN min(raw_k) = max(raw_k) THEN min(raw_k) END AS raw_top_k FROM case_runs GROUP BY run_id)"""
_ALL = f"WITH {X.METRICS}, {X.CASE_RUNS}, {X.RUNS}, {X.CASES}, {_STATS}, expected AS (SELECT dataset_id, count(*) AS expected_cases FROM cases WHERE status <> 'rejected' GROUP BY 1)"


def _at(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n), 9) for n in names})


@query(_ALL + " SELECT run_id, run_name, run_type, status, expected_cases, executed_cases, round(avg_latency_ms, 9) AS avg_latency_ms, CAST(coalesce(config_k, raw_top_k) AS VARCHAR) AS top_k FROM runs LEFT JOIN expected USING (dataset_id) LEFT JOIN stats USING (run_id)")
def run_list(spark, d):
    out = R.list_runs(X.runs(spark, d), X.cases(spark, d), X.case_runs(spark, d))
    return _rounded(out, "avg_latency_ms").select("run_id", "run_name", "run_type", "status", "expected_cases", "executed_cases", "avg_latency_ms", F.col("top_k").cast("string").alias("top_k"))


@query(_ALL + " SELECT run_id, dataset_name, executed_cases FROM runs JOIN (VALUES ('0', 'even'), ('1', 'odd')) t(dataset_id, dataset_name) USING (dataset_id) LEFT JOIN stats USING (run_id) WHERE dataset_id = '1'")
def run_list_of_dataset(spark, d):
    sets = spark.createDataFrame([("0", "even"), ("1", "odd")], "dataset_id string, name string").withColumns({"version": F.lit("v"), "status": F.lit("ready")})
    return R.list_runs(X.runs(spark, d), X.cases(spark, d), X.case_runs(spark, d), sets, "1").select("run_id", "dataset_name", "executed_cases")


@query(_ALL + " SELECT dataset_id, name, coalesce(n, 0) AS case_count, coalesce(m, 0) AS run_count, strftime(latest_run_at, '%Y-%m-%d %H:%M:%S') AS latest_run_at FROM (VALUES ('0', 'even'), ('1', 'odd'), ('2', 'none')) t(dataset_id, name) LEFT JOIN (SELECT dataset_id, expected_cases AS n FROM expected) USING (dataset_id) LEFT JOIN (SELECT dataset_id, count(*) AS m, max(started_at) AS latest_run_at FROM runs GROUP BY 1) USING (dataset_id)")
def dataset_list(spark, d):
    sets = spark.createDataFrame([("0", "even"), ("1", "odd"), ("2", "none")], "dataset_id string, name string").withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    return R.list_datasets(sets, X.cases(spark, d), X.runs(spark, d)).select("dataset_id", "name", "case_count", "run_count", _at("latest_run_at"))


@query(_ALL + """ SELECT run_id, expected_cases, executed_cases, abstained_cases, round(avg_latency_ms, 9) AS avg_latency_ms, round(p50_latency_ms, 9) AS p50_latency_ms, round(p95_latency_ms, 9) AS p95_latency_ms, input_tokens, output_tokens, context_tokens,
round(known_cost, 9) AS known_cost, cost_samples, raw_top_k, coalesce(config_k, raw_top_k) AS top_k FROM runs LEFT JOIN expected USING (dataset_id) LEFT JOIN stats USING (run_id) WHERE run_id = '2'""")
def run_summary(spark, d):
    out = R.run_summary("2", X.runs(spark, d), X.cases(spark, d), X.case_runs(spark, d))
    names = ("avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "known_cost")
    return _rounded(out, *names).select("run_id", "expected_cases", "executed_cases", "abstained_cases", *names, "input_tokens", "output_tokens", "context_tokens", "cost_samples", "raw_top_k", "top_k")


@query(_ALL + f" SELECT metric_name, evaluator_version, count(*) AS sample_count, round(avg(score), 9) AS mean_score, round(min(score), 9) AS min_score, round(max(score), 9) AS max_score FROM metrics WHERE run_id = '2' AND {_JUDGED} GROUP BY ALL")
def metric_summary(spark, d):
    return _rounded(R.metric_summary("2", X.metrics(spark, d)), "mean_score", "min_score", "max_score")


@query(_ALL + f" SELECT run_id, run_name, run_type, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, round(avg(score), 9) AS mean_score, count(*) AS sample_count FROM runs JOIN metrics USING (run_id) WHERE dataset_id = '1' AND status = 'completed' AND metric_name = 'mrr' AND {_JUDGED} GROUP BY ALL")
def metric_history(spark, d):
    return _rounded(R.metric_history("1", "mrr", X.runs(spark, d), X.metrics(spark, d)), "mean_score").withColumn("started_at", _at("started_at"))


@query(_ALL + f""", ms AS (SELECT run_id, avg(score) AS mean_score, count(*) AS metric_cases FROM metrics WHERE metric_name = 'mrr' AND {_JUDGED} GROUP BY 1)
SELECT run_id, run_name, run_type, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, prompt_version, corpus_version, round(mean_score, 9) AS mean_score, metric_cases, executed_cases, round(avg_latency_ms, 9) AS avg_latency_ms, round(p95_latency_ms, 9) AS p95_latency_ms, input_tokens, output_tokens
FROM runs JOIN ms USING (run_id) LEFT JOIN stats USING (run_id) WHERE dataset_id = '1'""")
def quality_latency(spark, d):
    return _rounded(R.quality_latency("1", X.runs(spark, d), X.case_runs(spark, d), X.metrics(spark, d)), "mean_score", "avg_latency_ms", "p95_latency_ms").withColumn("started_at", _at("started_at"))


_PAIRED = "SELECT b.score AS b, c.score AS c, c.score - b.score AS delta, metric_name, evaluator_version, case_id FROM (SELECT * FROM metrics WHERE run_id = '0') b JOIN (SELECT * FROM metrics WHERE run_id = '1') c USING (case_id, metric_name, evaluator_version)"


@query(_ALL + f" SELECT metric_name, evaluator_version, count(*) AS paired_cases, round(avg(b), 9) AS baseline_mean, round(avg(c), 9) AS candidate_mean, round(avg(delta), 9) AS mean_delta, round(min(delta), 9) AS min_delta, round(max(delta), 9) AS max_delta, round({_NORM.format('avg(delta)')}, 9) AS normalized_delta FROM ({_PAIRED}) GROUP BY metric_name, evaluator_version")
def compare_runs(spark, d):
    out = R.compare_runs("0", "1", X.metrics(spark, d))
    return _rounded(out, "baseline_mean", "candidate_mean", "mean_delta", "min_delta", "max_delta", "normalized_delta")


_RESULTS = """, results AS (SELECT cr.case_run_id, cr.run_id, cr.case_id, c.question, c.answerable, c.aircraft, c.variant, c.category, c.difficulty, c.split, cr.abstained, cr.retrieved_count, cr.latency_ms, m.score AS candidate_score, b.score AS baseline_score, m.score - b.score AS delta
FROM case_runs cr JOIN cases c USING (case_id) LEFT JOIN metrics m ON m.run_id = cr.run_id AND m.case_id = cr.case_id AND m.metric_name = 'mrr' LEFT JOIN metrics b ON b.run_id = '0' AND b.case_id = cr.case_id AND b.metric_name = 'mrr' AND b.evaluator_version = m.evaluator_version WHERE cr.run_id = '1')"""


def _results(spark, d):
    return R.case_results("1", X.case_runs(spark, d), X.cases(spark, d), X.metrics(spark, d), "0")


@query(_ALL + _RESULTS + " SELECT case_run_id, run_id, case_id, question, answerable, aircraft, variant, category, difficulty, split, abstained, retrieved_count, round(latency_ms, 9) AS latency_ms, round(candidate_score, 9) AS candidate_score, round(baseline_score, 9) AS baseline_score, round(delta, 9) AS delta, round(delta, 9) AS normalized_delta FROM results")
def case_results(spark, d):
    return _rounded(_results(spark, d), "latency_ms", "candidate_score", "baseline_score", "delta", "normalized_delta")


@query(_ALL + _RESULTS + " SELECT case_id, category, aircraft FROM results WHERE category = 'cat1' AND aircraft = 'a1' AND (contains(lower(case_id), '1') OR contains(lower(question), '1'))")
def case_explorer(spark, d):
    return R.explore(_results(spark, d), "cat1", "a1", "1").select("case_id", "category", "aircraft")


@query(_ALL + _RESULTS + " SELECT case_id, round(delta, 9) AS delta FROM results WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, case_id LIMIT 12")
def case_movers(spark, d):
    return R.movers(_results(spark, d)).select("case_id", F.round(F.col("delta"), 9).alias("delta"))


@query(_ALL + _RESULTS + ", e AS (SELECT min(delta) AS lo, max(delta) AS hi FROM results) SELECT CAST(CASE WHEN hi > lo THEN least(17, floor((delta - lo) / ((hi - lo) / 18))) ELSE 0 END AS INT) AS bin, count(*) AS n FROM results, e WHERE delta IS NOT NULL GROUP BY 1")
def delta_histogram(spark, d):
    return R.delta_histogram(_results(spark, d))


for _name, _sql in (("category", "category"), ("aircraft", "coalesce(aircraft, 'Unknown')"), ("variant", "coalesce(variant, 'Unknown')"), ("difficulty", "difficulty"), ("split", "split"), ("answerable", "CAST(answerable AS VARCHAR)")):
    ORACLES[f"breakdown_{_name}"] = (_ALL + f" SELECT {_sql} AS dimension_value, count(*) AS sample_count, round(avg(score), 9) AS mean_score FROM metrics JOIN cases USING (case_id) WHERE run_id = '2' AND metric_name = 'mrr' AND {_JUDGED} GROUP BY 1")
    QUERIES[f"breakdown_{_name}"] = lambda spark, d, n=_name: _rounded(R.breakdown("2", X.metrics(spark, d), X.cases(spark, d), n), "mean_score")


@query(_ALL + " SELECT metric_name, round(score, 9) AS score, evaluator_version FROM metrics WHERE run_id = '2' AND case_id = 'c07'")
def case_metrics(spark, d):
    return _rounded(R.case_metrics("2", "c07", X.metrics(spark, d)), "score").drop("details")


@query(_ALL + " SELECT case_run_id, case_id, question, answerable, category, abstained, retrieved_count, input_tokens FROM case_runs JOIN cases USING (case_id) WHERE run_id = '2' AND case_id = 'c07'")
def case_detail(spark, d):
    return R.case_detail("2", "c07", X.case_runs(spark, d), X.cases(spark, d)).select("case_run_id", "case_id", "question", "answerable", "category", "abstained", "retrieved_count", "input_tokens")


def _summary(spark, d, run):
    rows = R.run_summary(run, X.runs(spark, d), X.cases(spark, d), X.case_runs(spark, d))
    tokens = R.metric_summary(run, X.metrics(spark, d)).where("metric_name = 'retrieved_tokens'").select(F.lit(run).alias("run_id"), F.col("mean_score").alias("retrieved_tokens"))
    return rows.join(tokens, "run_id", "left")


_RES = [("p50 latency", "p50_latency_ms", "milliseconds"), ("p95 latency", "p95_latency_ms", "milliseconds"), ("Average latency", "avg_latency_ms", "milliseconds"), ("Context tokens", "context_tokens", "tokens"), ("Input tokens", "input_tokens", "tokens"), ("Output tokens", "output_tokens", "tokens"), ("Known cost", "known_cost", "currency")]


@query(_ALL + ", t AS (SELECT run_id, avg(score) AS v FROM metrics WHERE metric_name = 'retrieved_tokens' GROUP BY 1), r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS label, '{u}' AS unit, (SELECT {k}::DOUBLE FROM stats WHERE run_id = '1') AS c, (SELECT {k}::DOUBLE FROM stats WHERE run_id = '0') AS b, true AS lower" for a, k, u in _RES) + " UNION ALL SELECT 'Retrieved tokens', 'tokens', (SELECT v FROM t WHERE run_id = '1'), (SELECT v FROM t WHERE run_id = '0'), false) SELECT label, unit, round(c, 9) AS candidate, round(b, 9) AS baseline, round(c - b, 9) AS delta, round(CASE WHEN lower THEN b - c END, 9) AS normalized_delta FROM r")
def resource_rows(spark, d):
    out = R.resource_rows(_summary(spark, d, "0"), _summary(spark, d, "1"))
    return _rounded(out, "candidate", "baseline", "delta", "normalized_delta").select("label", "unit", "candidate", "baseline", "delta", "normalized_delta")


_CONCEPTS = "('recall_at_5', 'Recall@5'), ('mrr', 'MRR'), ('ndcg_at_5', 'nDCG@5'), ('hit_rate_at_5', 'HitRate@5'), ('precision_at_5', 'Precision@5'), ('unique_parent_ratio', 'Unique parent ratio'), ('duplicate_ratio', 'Duplicate ratio'), ('retrieved_items', 'Retrieved items'), ('retrieved_tokens', 'Retrieved tokens')"


@query(_ALL + f""", s AS (SELECT run_id, metric_name, avg(score) AS v, count(*) AS n FROM metrics WHERE {_JUDGED} GROUP BY 1, 2), j AS (SELECT metric_name, label, a.v AS c, b.v AS b, a.n AS cn, b.n AS bn FROM (VALUES {_CONCEPTS}) t(metric_name, label)
LEFT JOIN (SELECT * FROM s WHERE run_id = '1') a USING (metric_name) LEFT JOIN (SELECT * FROM s WHERE run_id = '0') b USING (metric_name))
SELECT label, metric_name, round(b, 9) AS baseline_mean, round(c, 9) AS candidate_mean, coalesce(bn, 0) AS baseline_samples, coalesce(cn, 0) AS candidate_samples, round(c - b, 9) AS delta, round({_NORM.format('(c - b)')}, 9) AS normalized_delta FROM j""")
def concept_rows(spark, d):
    m = X.metrics(spark, d)
    out = _rounded(R.concept_rows(R.metric_summary("0", m), R.metric_summary("1", m), 5, 5), "baseline_mean", "candidate_mean", "delta", "normalized_delta")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("baseline_samples", "candidate_samples")})
    return out.select("label", F.col("candidate_metric_name").alias("metric_name"), "baseline_mean", "candidate_mean", "baseline_samples", "candidate_samples", "delta", "normalized_delta")


@query(_ALL + " SELECT case_id, printf('%.3f', v) AS score, printf('%.1f%%', v * 100) AS percent, printf('%.2f s', 1000 * (v + 1) / 1000) AS seconds, printf('$%.4f', v) AS cost, CASE WHEN v > 0.5 THEN '+' ELSE '' END || printf('%.3f', v - 0.5) AS delta FROM (SELECT case_id, round(avg(score) * 4) / 4 % 1 AS v FROM metrics GROUP BY 1)")
def displayed_values(spark, d):
    v = F.round(F.avg("score") * 4) / 4 % 1
    rows = X.metrics(spark, d).groupBy("case_id").agg(v.alias("v"))
    x = F.col("v")
    return rows.select("case_id", M.shown(x).alias("score"), M.shown(x, "percent").alias("percent"), M.shown(1000 * (x + 1), "milliseconds").alias("seconds"), M.shown(x, "currency").alias("cost"), M.shown_delta(x - 0.5).alias("delta"))


_FIELDS = [("Run name", "run_name"), ("Run type", "run_type"), ("Status", "status"), ("Dataset", "dataset_id"), ("Corpus", "corpus_version"), ("Prompt", "prompt_version")]


@query(_ALL + ", f AS (" + " UNION ALL ".join(f"SELECT '{a}' AS field, (SELECT {c} FROM runs WHERE run_id = '3') AS evaluation_a, (SELECT {c} FROM runs WHERE run_id = '1') AS evaluation_b" for a, c in _FIELDS) + ") SELECT *, CASE WHEN evaluation_a IS NOT DISTINCT FROM evaluation_b THEN 'yes' ELSE 'no' END AS same FROM f")
def field_rows(spark, d):
    runs = X.runs(spark, d)
    return R.field_rows(runs.where("run_id = '1'"), runs.where("run_id = '3'"), _FIELDS).drop("ordinal")


@query(_ALL + """ SELECT 'default' AS pick, run_id FROM (SELECT * FROM runs ORDER BY CASE WHEN status = 'completed' AND run_type <> 'baseline' THEN 0 WHEN status = 'completed' THEN 1 ELSE 2 END, started_at DESC, run_id LIMIT 1)
UNION ALL SELECT 'baseline', run_id FROM (SELECT * FROM runs WHERE dataset_id = '0' AND run_id <> '2' ORDER BY CASE WHEN status = 'completed' AND run_type = 'baseline' THEN 0 WHEN status = 'completed' THEN 1 ELSE 2 END, started_at DESC, run_id LIMIT 1)""")
def baseline_pick(spark, d):
    runs = X.runs(spark, d)
    a = R.default_run(runs).select(F.lit("default").alias("pick"), "run_id")
    return a.union(R.recommended_baseline(runs, "2", "0").select(F.lit("baseline").alias("pick"), "run_id"))


@query(_ALL + f""" SELECT metric_name, case_id, CASE metric_name WHEN 'mrr' THEN 'MRR' WHEN 'duplicate_ratio' THEN 'Duplicate ratio' WHEN 'recall_at_5' THEN 'Recall@5' WHEN 'retrieved_tokens' THEN 'Retrieved tokens' ELSE 'nDCG@5' END AS label,
CASE metric_name WHEN 'duplicate_ratio' THEN 'minimize' WHEN 'retrieved_tokens' THEN 'tradeoff' ELSE 'maximize' END AS direction,
CASE WHEN metric_name = 'retrieved_tokens' THEN 'Trade-off' WHEN abs(delta) < 0.0005 THEN 'Tie' WHEN {_NORM.format('delta')} > 0 THEN 'A wins' ELSE 'B wins' END AS winner,
CASE WHEN c >= 0.8 THEN 'good' WHEN c >= 0.5 THEN 'fair' ELSE 'poor' END AS class FROM ({_PAIRED})""")
def measure_reading(spark, d):
    n = F.col("metric_name")
    return R.paired("0", "1", X.metrics(spark, d)).select(
        "metric_name", "case_id", M.label(n).alias("label"), M.direction(n).alias("direction"), M.winner(M.normalized_delta(n, F.col("delta"))).alias("winner"), M.score_class(F.col("candidate_score")).alias("class"),
    )


@query(_ALL + """ SELECT run_id, to_json({'top_k': 7}) AS public_config, to_json({'generator_model': 'g'}) AS public_model_versions FROM runs WHERE run_id = '2'""")
def public_settings(spark, d):
    return R.run_summary("2", X.runs(spark, d), X.cases(spark, d), X.case_runs(spark, d)).select("run_id", "public_config", "public_model_versions")


@query("""SELECT event_type, round(percentile_cont(0.0) WITHIN GROUP (ORDER BY value), 9) AS p0, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 9) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 9) AS p95,
round(percentile_cont(1.0) WITHIN GROUP (ORDER BY value), 9) AS p100 FROM events GROUP BY 1""")
def event_percentiles(spark, d):
    """Exact percentiles of all values by type, by selection beyond a thousand values."""
    out = selection.percentiles(table(spark, d, "events"), "event_type", "value", [0.0, 0.5, 0.95, 1.0], buffer=1000)
    return _rounded(out, "p0", "p50", "p95", "p100")
