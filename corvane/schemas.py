"""Schemas of the engine's tables and the constraints that their rows must meet.

Spark enforces no keys, so each constraint is a query that returns the rows in breach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "children": "chunk_id string, parent_id string, name string, source string, text string, embedding array<float>, document_id string, source_file string, token_count int",
    "parents": "parent_id string, name string, source string, text string, document_id string, source_file string, token_count int",
    "cases_index": "case_key bigint, case_number string, event_date date, event_time string, city string, location string, state string, country string, country_code string, event_type string, severity string, investigation_status string, fatalities int, serious_injuries int, minor_injuries int, total_injuries int, narrative string, probable_cause string, airport string, runway string, source_updated_at timestamp, synced_at timestamp",
    "parties": "case_key bigint, sequence int, make string, model string, registration string, category string, operation string, damage string",
    "case_events": "case_key bigint, sequence int, text string",
    "case_findings": "case_key bigint, sequence int, text string",
    "case_airports": "case_key bigint, sequence int, airport string, runway string",
    "detail_cache": "case_key bigint, payload string, hash string, fetched_at timestamp",
    "sync_checkpoints": "stream string, window_start date, window_end date, status string, updated_at timestamp",
    "sync_runs": "run_id string, stream string, started_at timestamp, ended_at timestamp, status string, read bigint, rejected bigint, inserted bigint, updated bigint, repeated bigint, error string",
    "datasets": "dataset_id string, name string, version string, status string, created_at timestamp",
    "cases": "case_id string, dataset_id string, question string, reference_answer string, answerable boolean, expected_abstention boolean, aircraft string, variant string, category string, difficulty string, split string, expected_facts string, expected_numbers string, tags string, status string",
    "evidence": "evidence_id bigint, case_id string, source_file string, document_id string, parent_id string, chunk_id string, line_start int, line_end int, quote string, relevance int, evidence_type string",
    "runs": "run_id string, dataset_id string, run_name string, run_type string, git_commit string, corpus_version string, prompt_version string, config string, model_versions string, status string, started_at timestamp, ended_at timestamp, total_cost double, total_latency_ms double, error string",
    "case_runs": "case_run_id bigint, run_id string, case_id string, answer string, abstained boolean, trace_id string, retrieved_count int, context_tokens bigint, input_tokens bigint, output_tokens bigint, estimated_cost double, latency_ms double, timings string, raw_output string",
    "retrieved_items": "case_run_id bigint, rank int, document_id string, parent_id string, chunk_id string, aircraft string, variant string, vector_rank int, keyword_rank int, vector_score double, keyword_score double, rrf_score double, token_count int, relevance int, is_duplicate boolean",
    "context_items": "case_run_id bigint, position int, parent_id string, source_file string, token_count int, selected boolean",
    "metrics": "case_run_id bigint, run_id string, case_id string, metric_name string, score double, details string, evaluator_version string",
    "feedback": "feedback_id bigint, run_id string, case_id string, trace_id string, rating int, label string, comment string, corrected_answer string, promoted_to_case string",
}
KEYS = {
    "children": ["chunk_id"], "parents": ["parent_id"], "cases_index": ["case_key"], "parties": ["case_key", "sequence"], "case_events": ["case_key", "sequence"],
    "case_findings": ["case_key", "sequence"], "case_airports": ["case_key", "sequence"], "datasets": ["name", "version"], "cases": ["case_id"],
    "evidence": ["case_id", "source_file", "line_start", "line_end", "quote"], "runs": ["run_id"], "case_runs": ["run_id", "case_id"],
    "retrieved_items": ["case_run_id", "rank"], "context_items": ["case_run_id", "position"], "metrics": ["case_run_id", "metric_name", "evaluator_version"],
}
RULES = {
    "cases": {"answerable or abstention expected": "answerable or expected_abstention", "no answer to what can't be answered": "answerable or reference_answer is null"},
    "evidence": {"relevance from 0 to 3": "relevance between 0 and 3"},
    "retrieved_items": {"rank from 1": "rank > 0", "relevance from 0 to 3": "relevance is null or relevance between 0 and 3"},
    "context_items": {"position from 1": "position > 0"},
    "feedback": {"rating from 1 to 5": "rating is null or rating between 1 and 5"},
    "runs": {"known status": "status in ('running', 'completed', 'failed')"},
}


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def repeated_keys(name: str, rows: DataFrame) -> DataFrame:
    """Keys that stand on several rows, with their number."""
    return rows.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).where("n > 1")


def breaches(name: str, rows: DataFrame) -> DataFrame:
    """(rule, n) of the rules that rows break; a rule that is null for a row holds."""
    rules = RULES.get(name, {})
    if not rules:
        return rows.sparkSession.createDataFrame([], "rule string, n bigint")
    counted = rows.agg(*(F.count_if(~F.coalesce(F.expr(sql), F.lit(True))).alias(f"r{i}") for i, sql in enumerate(rules.values())))
    stacked = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("n")) for i, rule in enumerate(rules)))
    return counted.select(F.explode(stacked).alias("x")).select("x.*").where("n > 0")
