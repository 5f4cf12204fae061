"""Queries on point look-ups, plans, details, data-set checks and conversions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import control, values
from corvane.functions import text as texts
from corvane.operators import cases as C
from corvane.operators import evaluation, normalizing, planning
from corvane.operators import reports as R
from corvane.plans import fixtures as X
from corvane.session import table
from corvane.sources import files
from corvane.streaming import feed

QUERIES, ORACLES = {}, {}
_W = f"WITH {X.INCIDENTS}"
_ALL = f"WITH {X.METRICS}, {X.CASE_RUNS}, {X.RUNS}, {X.CASES}"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# cases


@query(_W + " SELECT case_key, case_number FROM incidents WHERE case_key = 7")
def case_by_key(spark, d):
    return C.matching(X.incidents(spark, d), None, C.CaseQuery(case_key="7")).select("case_key", "case_number")


@query("SELECT count(*) AS cases, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_event, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_event, max(o_orderkey) AS last_synced_at FROM orders")
def index_status(spark, d):
    cases = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("event_date"), "o_orderkey")
    found = C.index_status(cases, "o_orderkey")
    return found.select("cases", *(F.col(c).cast("string").alias(c) for c in ("first_event", "last_event")), "last_synced_at")


@query("SELECT o_orderkey AS case_key, last AS detail_fetched_at, payload FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(n) AS last, arg_max(p, n) AS payload FROM (SELECT l_orderkey, l_linenumber AS n, 'p' || l_linenumber AS p FROM lineitem WHERE l_linenumber % 2 = 0) GROUP BY 1) ON k = o_orderkey")
def case_detail_state(spark, d):
    details = table(spark, d, "lineitem").where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("case_key"), F.col("l_linenumber").alias("fetched_at"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("payload"))
    return C.with_detail_state(table(spark, d, "orders").select(F.col("o_orderkey").alias("case_key")), details)


@query(_W + " SELECT case_key, narrative IS NULL OR airport = '' AS refresh FROM (SELECT case_key, probable_cause, CASE WHEN case_key % 2 = 0 THEN city END AS narrative, CASE WHEN case_key % 3 = 0 THEN '' ELSE location END AS airport FROM incidents)")
def detail_refresh(spark, d):
    rows = X.incidents(spark, d).withColumns({
        "narrative": F.when(F.col("case_key") % 2 == 0, F.col("city")), "airport": F.when(F.col("case_key") % 3 == 0, "").otherwise(F.col("location")), "detail_fetched_at": F.lit(None).cast("timestamp"),
    })
    return rows.select("case_key", C.needs_refresh(C.CaseQuery(requested_fields=["narrative", "airport", "date"])).alias("refresh"))


@query(_W + ", t AS (SELECT count(*) AS n FROM incidents WHERE severity ILIKE '%fatal%' OR coalesce(fatalities, 0) > 0) SELECT 0 AS ordinal, 'Index metadata: cases selected from ' || n || ' matching cases by fatalities, order desc. Last sync: unknown.' AS text FROM t UNION ALL SELECT 1, case_number FROM (SELECT * FROM incidents WHERE severity ILIKE '%fatal%' OR coalesce(fatalities, 0) > 0 ORDER BY fatalities DESC NULLS LAST, event_date DESC NULLS LAST, case_key LIMIT 10)")
def case_context_items(spark, d):
    q = C.CaseQuery(severity="fatal", ranking_field="fatalities")
    found = C.matching(X.incidents(spark, d), None, q)
    return C.context_items(C.page(found, q).select(F.col("case_number").alias("text")), q, found.count(), None)


@query("SELECT o_orderkey, o_orderpriority <> '1-URGENT' AND o_custkey > o_orderkey AS truncated FROM orders")
def truncation(spark, d):
    goal = F.when(F.col("o_orderpriority") == "1-URGENT", "rank").otherwise("search")
    return table(spark, d, "orders").select("o_orderkey", C.truncated(goal, F.col("o_custkey"), F.col("o_orderkey")).alias("truncated"))


# plans and details

_ASKED = "CASE turn % 6 WHEN 0 THEN 'the highest number of fatal cases, ' || text WHEN 1 THEN 'over the last ' || (conv_id % 30) || ' years' WHEN 2 THEN 'see abc' || lpad(CAST(conv_id % 100 AS VARCHAR), 2, '0') || 'xy' || lpad(CAST(turn AS VARCHAR), 3, '0') || '.' WHEN 3 THEN 'MKEY # ' || conv_id WHEN 4 THEN 'what is the probable cause' ELSE text END"


@query(f"""WITH q AS (SELECT conv_id, turn, lower({_ASKED}) AS t FROM conversations),
p AS (SELECT *, regexp_matches(t, '{planning.DEADLIEST}') AS deadliest, TRY_CAST(regexp_extract(t, '{planning.PAST_YEARS}', 1) AS INT) AS years, upper(nullif(regexp_extract(t, '\\b[a-z]{{3}}\\d{{2}}[a-z]{{2}}\\d{{3}}\\b'), '')) AS number, TRY_CAST(regexp_extract(t, '\\bmkey\\s*[:#]?\\s*(\\d+)\\b', 1) AS BIGINT) AS key,
  regexp_matches(t, '{"|".join(f"(?:{p})" for p in planning.WHOLE_CASE)}') AS detail FROM q)
SELECT conv_id, turn, CASE WHEN number IS NOT NULL OR key IS NOT NULL THEN 'lookup' WHEN deadliest THEN 'rank' END AS goal, CASE WHEN years > 0 THEN CAST(CAST(DATE '2024-02-29' - to_years(years) AS DATE) AS VARCHAR) END AS start_date, number AS case_number, key AS case_key,
  CASE WHEN deadliest OR detail THEN true END AS needs_detail, CASE WHEN deadliest OR detail THEN {len(planning.FULL_FIELDS)} ELSE 0 END AS fields FROM p""")
def plan_repair(spark, d):
    t = F.col("turn") % 6
    text, conv = F.col("text"), F.col("conv_id").cast("string")
    asked = F.when(t == 0, F.concat(F.lit("the highest number of fatal cases, "), text)).when(t == 1, F.concat(F.lit("over the last "), (F.col("conv_id") % 30).cast("string"), F.lit(" years")))
    asked = asked.when(t == 2, F.format_string("see abc%02dxy%03d.", F.col("conv_id") % 100, F.col("turn"))).when(t == 3, F.concat(F.lit("MKEY # "), conv)).when(t == 4, "what is the probable cause").otherwise(text)
    plans = planning.completed(table(spark, d, "conversations").select("conv_id", "turn", asked.alias("question")), F.lit("2024-02-29").cast("date"))
    return plans.select("conv_id", "turn", "goal", "start_date", "case_number", "case_key", "needs_detail", F.coalesce(F.size("requested_fields"), F.lit(0)).alias("fields")).withColumn("fields", F.greatest("fields", F.lit(0)))


@query("""SELECT o_orderkey AS case_key, CASE WHEN o_orderkey % 10 = 9 THEN 'The live record has no fields that can be shown.' ELSE concat_ws(chr(10), 'Fields of the live record:', CASE WHEN o_orderkey % 10 > 0 THEN 'data[1].mkey: ' || o_orderkey END, 'data[1].event.priority: ' || o_orderpriority,
'data[1].weather-notes: clear sky', 'data[1].Prob_Cause[1]: ' || CASE WHEN o_orderkey % 3 = 0 THEN repeat('x', 1200) || '...' ELSE 'ice' END, 'data[1].Prob_Cause[2]: b') END AS text FROM orders""")
def detail_texts(spark, d):
    k = F.col("o_orderkey")
    cause = F.array(F.when(k % 3 == 0, F.repeat(F.lit("x"), F.lit(1300))).otherwise("ice"), F.lit("b"), F.lit("  "))
    record = F.struct(F.when(k % 10 > 0, k).alias("mkey"), F.struct(F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("none")).alias("event"), F.lit("t").alias("token"), F.lit(" clear \t sky ").alias("weather-notes"), cause.alias("Prob_Cause"))
    payload = F.when(k % 10 == 9, '{"token": 1}').otherwise(F.to_json(F.struct(F.array(record).alias("data"))))
    return normalizing.detail_texts(table(spark, d, "orders").select(k.alias("case_key"), payload.alias("payload")))


@query("SELECT count(*) AS records, CAST(count(*) FILTER (o_orderkey % 10 > 0) AS BIGINT) AS accepted, CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS rejected, CAST(sum(length('{\"id\":' || CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'null' END || ',\"z\":1}')) AS BIGINT) AS chars FROM orders")
def payload_counters(spark, d):
    k = F.col("o_orderkey")
    payload = F.format_string('{"records": [{"z": 1, "id": %s}]}', F.when(k % 10 > 0, k.cast("string")).otherwise("null"))
    typed = normalizing.cases(normalizing.records(table(spark, d, "orders").select(k.alias("ordinal"), payload.alias("payload")), fields=("case_key", "record")))
    return typed.agg(F.count("*").alias("records"), F.count("case_key").alias("accepted"), F.count_if(F.col("case_key").isNull()).alias("rejected"), F.sum(F.length(F.regexp_replace("record", " ", ""))).alias("chars"))


@query("SELECT o_orderkey, sha256('{\"a\":' || (o_orderkey % 7) || ',\"mkey\":' || o_orderkey || '}') AS hash FROM orders")
def payload_hashes(spark, d):
    payload = F.format_string('[{"mkey": %d, "a": %d}]', F.col("o_orderkey"), F.col("o_orderkey") % 7)
    rows = normalizing.records(table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), payload.alias("payload")))
    return rows.select(F.col("ordinal").alias("o_orderkey"), "hash")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE c_nationkey WHEN 6 THEN 'FR' WHEN 7 THEN 'DE' WHEN 3 THEN 'CA' END END AS country_code FROM customer")
def country_codes(spark, d):
    known = spark.createDataFrame([("nation_6", "FR"), ("nation_7", "DE"), ("nation_3", "CA")], "name string, code string")
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = table(spark, d, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), F.translate("n_name", "AE", "ÁÉ"), F.lit("\t"))).alias("country"))
    return normalizing.with_country_codes(rows, known).select("c_custkey", "country_code")


# conversions


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00' END AS at, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M:%S') WHEN event_id % 3 = 1 THEN CAST(hour(ts) AS VARCHAR) || ':' || strftime(ts, '%M') END AS clock FROM events")
def time_values(spark, d):
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    said = F.when(k % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 1, F.date_format(ts, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(ts, "dd/MM/yyyy"))
    clock = F.when(k % 3 == 0, F.date_format(ts, "  HH:mm:ss.SSS")).when(k % 3 == 1, F.concat(F.date_format(ts, "H:mm"), F.lit(" local"))).otherwise("noon")
    return table(spark, d, "events").select("event_id", F.date_format(values.to_timestamp(said), "yyyy-MM-dd HH:mm:ss").alias("at"), values.to_time(clock).alias("clock"))


@query("SELECT doc_id, '<doc>' || chr(10) || 'id: ' || doc_id || chr(10) || 'source: &lt;' || source || '&gt;' || chr(10) || 'none: ' || chr(10) || '</doc>' AS block FROM documents")
def prompt_blocks(spark, d):
    fields = {"id": F.col("doc_id"), "source": F.concat(F.lit("<"), "source", F.lit(">")), "none": F.lit(None).cast("string")}
    return table(spark, d, "documents").select("doc_id", texts.prompt_block("doc", fields).alias("block"))


@query("SELECT conv_id, turn, turn % 3 = 0 AND NOT turn % 2 = 0 AS must FROM conversations")
def must_abstain(spark, d):
    evidence = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return table(spark, d, "conversations").select("conv_id", "turn", control.must_abstain(evidence, F.col("turn") % 2 == 0).alias("must"))


# data sets and reports


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'd0' ELSE 'd' || doc_id END AS id, CASE WHEN doc_id % 40 <> 3 THEN 'f' || doc_id END AS path, CASE WHEN doc_id % 30 = 4 THEN -1 ELSE n_chars END AS n FROM documents)
SELECT id AS document_id, 'duplicate id' AS error FROM m GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, 'no path' FROM m WHERE path IS NULL UNION ALL SELECT id, 'missing file' FROM m WHERE path IS NOT NULL AND doc_id % 20 = 7 UNION ALL SELECT id, 'invalid line count' FROM m WHERE n < 0""")
def manifest_checks(spark, d):
    k = F.col("doc_id")
    path = F.when(k % 40 != 3, F.concat(F.lit("f"), k.cast("string")))
    docs = table(spark, d, "documents")
    rows = docs.select(F.when(k % 50 == 1, "d0").otherwise(F.concat(F.lit("d"), k.cast("string"))).alias("document_id"), path.alias("path"), F.when(k % 30 == 4, -1).otherwise(F.col("n_chars")).alias("line_count"))
    return files.manifest_errors(rows, docs.where(k % 20 != 7).select(path.alias("path")))


@query("""SELECT CAST(doc_id AS VARCHAR) AS case_id, 'missing source' AS error FROM labels WHERE doc_id % 9 = 0 UNION ALL SELECT CAST(l.doc_id AS VARCHAR), 'lines out of range' FROM labels l JOIN documents d USING (doc_id) WHERE l.doc_id % 9 > 0 AND (l.doc_id % 5 < 1 OR l.doc_id % 700 > d.n_chars)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'no evidence' FROM documents d WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def evidence_checks(spark, d):
    k = F.col("doc_id")
    evidence = table(spark, d, "labels").select(k.cast("string").alias("case_id"), F.when(k % 9 == 0, "nowhere").otherwise(k.cast("string")).alias("source_file"), (k % 5).alias("line_start"), (k % 700).alias("line_end"))
    docs = table(spark, d, "documents")
    return files.evidence_errors(evidence, docs.select(k.cast("string").alias("path"), F.col("n_chars").alias("line_count")), docs.select(k.cast("string").alias("case_id"), (k % 2 == 0).alias("answerable")))


@query("SELECT doc_id, doc_id % 3 = 0 OR doc_id % 6 = 0 AS same_dataset_id, doc_id % 4 = 0 AS same_corpus_version FROM documents")
def compatible_runs(spark, d):
    k = F.col("doc_id")
    known = lambda c: F.when(c, "x")
    rows = table(spark, d, "documents").select("doc_id", F.struct(F.when(k % 3 > 0, "x").alias("dataset_id"), known(k % 4 > 0).alias("corpus_version")).alias("a"), F.struct(F.lit(None).cast("string").alias("dataset_id"), known(F.lit(False)).alias("corpus_version")).alias("b"))
    return rows.select("doc_id", *control.compatible("a", "b", ("dataset_id", "corpus_version")))


@query(_ALL + " SELECT run_id, round(coalesce(sum(estimated_cost), 0), 4) AS total_cost, round(coalesce(sum(latency_ms), 0), 4) AS total_latency_ms FROM case_runs WHERE run_id = '3' GROUP BY 1")
def run_totals(spark, d):
    found = evaluation.totals(X.case_runs(spark, d).where("run_id = '3'"))
    return found.select(F.lit("3").alias("run_id"), F.round("total_cost", 4).alias("total_cost"), F.round("total_latency_ms", 4).alias("total_latency_ms"))


@query("SELECT evidence_id, relevance FROM (SELECT doc_id AS evidence_id, CASE WHEN doc_id % 4 > 0 THEN quality + toxic END AS relevance, doc_id % 10 AS case_id FROM labels) WHERE case_id = 3")
def evidence_of_case(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "labels").select((k % 10).alias("case_id"), k.alias("evidence_id"), F.when(k % 4 > 0, F.col("quality") + F.col("toxic")).alias("relevance"))
    return R.evidence_of(3, rows)


@query("SELECT l_linenumber AS rank, l_partkey AS item_id, 'item' AS kind FROM lineitem WHERE l_orderkey = 7 UNION ALL SELECT l_linenumber, l_suppkey, 'context' FROM lineitem WHERE l_orderkey = 7")
def items_of_case(spark, d):
    rows = table(spark, d, "lineitem")
    items = rows.select(F.col("l_orderkey").alias("case_run_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("item_id"))
    context = rows.select(F.col("l_orderkey").alias("case_run_id"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("item_id"))
    return R.retrieved_items(7, items).withColumn("kind", F.lit("item")).union(R.context_items(7, context).withColumn("kind", F.lit("context")))


@query(_ALL + " SELECT metric_name, case_id, round(delta, 6) AS delta FROM (SELECT a.metric_name, a.case_id, a.score - b.score AS delta FROM metrics a JOIN metrics b USING (case_id, metric_name) WHERE a.run_id = '1' AND b.run_id = '0' AND metric_name IN ('mrr', 'recall_at_5')) ORDER BY abs(delta) DESC, metric_name, case_id LIMIT 20")
def table_rows(spark, d):
    m = X.metrics(spark, d).where("metric_name in ('mrr', 'recall_at_5')")
    side = lambda run, name: m.where(f"run_id = '{run}'").select("metric_name", "case_id", F.col("score").alias(name))
    pairs = side("1", "a").join(side("0", "b"), ["metric_name", "case_id"]).withColumn("delta", F.col("a") - F.col("b"))
    return R.first_rows(pairs, [F.desc(F.abs("delta")), "metric_name", "case_id"]).select("metric_name", "case_id", F.round("delta", 6).alias("delta"))


@query("""WITH b AS (SELECT CASE WHEN event_id % 7 > 0 THEN user_id END AS k FROM events), g AS (SELECT k, count(*) AS n FROM b WHERE k IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM b) AS read, (SELECT count(*) FROM b WHERE k IS NULL) AS rejected, count(*) FILTER (k % 2 = 0) AS updated, count(*) FILTER (k % 2 <> 0) AS inserted, CAST(sum(n - 1) AS BIGINT) AS repeated FROM g""")
def sync_counters(spark, d):
    events = table(spark, d, "events")
    batch = events.select(F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("case_key"))
    return feed.counters(batch, events.where("user_id % 2 = 0").select(F.col("user_id").alias("case_key")))
