"""Queries on case search, merges, payloads, control and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.functions import control, values
from corvane.functions import text as texts
from corvane.operators import cases as C
from corvane.operators import chunking, merging, normalizing, retrieval
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


def _texts(*names):
    return [F.col(n).cast("string").alias(n) for n in names]


def _at(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_W = f"WITH {X.INCIDENTS}, {X.PARTIES}"
_WANTED = C.CaseQuery(start_date="1995-01-01", end_date="1997-12-31", location="AS", severity="fatal", event_type="build")
_WHERE = "event_date >= DATE '1995-01-01' AND event_date <= DATE '1997-12-31' AND (location ILIKE '%AS%' OR city ILIKE '%AS%') AND (severity ILIKE '%fatal%' OR coalesce(fatalities, 0) > 0) AND event_type ILIKE '%build%'"


@query(_W + f" SELECT count(*) AS total FROM incidents WHERE {_WHERE}")
def case_count(spark, d):
    return C.matching(X.incidents(spark, d), None, _WANTED).agg(F.count("*").alias("total"))


@query(_W + " SELECT case_key, case_number, CAST(event_date AS VARCHAR) AS event_date, country, severity, CAST(fatalities AS VARCHAR) AS fatalities FROM incidents WHERE upper(country_code) = 'EU' AND severity ILIKE '%urgent%' AND investigation_status ILIKE '%f%' ORDER BY event_date DESC NULLS LAST, case_key LIMIT 25")
def case_filter(spark, d):
    q = C.CaseQuery(country="Europe", severity="urgent", investigation_status="f", limit=25)
    found = C.matching(X.incidents(spark, d), None, q, country_code="EU")
    return C.page(found, q).select("case_key", "case_number", *_texts("event_date"), "country", "severity", *_texts("fatalities"))


@query(_W + " SELECT case_key FROM incidents WHERE upper(case_number) = 'ABC07XY007'")
def case_lookup(spark, d):
    return C.matching(X.incidents(spark, d), None, C.CaseQuery(case_number="abc07xy007")).select("case_key")


@query(_W + f" SELECT case_key FROM incidents WHERE list_has_all({X.TERMS.format(chr(39) + chr(39) + ' || concat_ws(' + chr(39) + ' ' + chr(39) + ', case_number, city, location, state, country, event_type, severity, investigation_status, probable_cause)')}, ['europe', 'high'])")
def case_fulltext(spark, d):
    return C.matching(X.incidents(spark, d), None, C.CaseQuery(text="Europe HIGH")).select("case_key")


@query(_W + " SELECT case_key FROM incidents i WHERE EXISTS (SELECT 1 FROM parties p WHERE p.case_key = i.case_key AND upper(registration) LIKE '%N1%') AND EXISTS (SELECT 1 FROM parties p WHERE p.case_key = i.case_key AND make ILIKE '%#2%') AND EXISTS (SELECT 1 FROM parties p WHERE p.case_key = i.case_key AND model ILIKE '%econ%')")
def case_child_exists(spark, d):
    q = C.CaseQuery(registration="n1", make="#2", model="econ")
    return C.matching(X.incidents(spark, d), X.parties(spark, d), q).select("case_key")


def _page(name, q, order):
    ORACLES[name] = _W + f" SELECT case_key, CAST(fatalities AS VARCHAR) AS fatalities, CAST(total_injuries AS VARCHAR) AS total_injuries, CAST(event_date AS VARCHAR) AS event_date FROM (SELECT * FROM incidents ORDER BY {order} LIMIT {q.limit})"
    QUERIES[name] = lambda spark, d: C.page(X.incidents(spark, d), q).select("case_key", *_texts("fatalities", "total_injuries", "event_date"))


_page("case_rank_desc", C.CaseQuery(goal="rank", ranking_field="fatalities", limit=20), "fatalities DESC NULLS LAST, event_date DESC NULLS LAST, case_key")
_page("case_rank_asc_nulls_first", C.CaseQuery(goal="rank", ranking_field="injuries", ranking_order="asc", limit=20), "total_injuries ASC NULLS FIRST, event_date DESC NULLS LAST, case_key")
_page("case_by_date", C.CaseQuery(sort="date_asc", limit=100), "event_date ASC NULLS LAST, case_key")


def _nested(spark, d):
    q = C.CaseQuery(goal="rank", ranking_field="fatalities", limit=50)
    page = C.page(X.incidents(spark, d), q)
    p = X.parties(spark, d)
    events = p.where("sequence <= 2").select("case_key", "sequence", F.col("make").alias("text"))
    return C.nested(page, p, events, extra_order=("part", "supp", "price"))


_TOP = "top AS (SELECT * FROM incidents ORDER BY fatalities DESC NULLS LAST, event_date DESC NULLS LAST, case_key LIMIT 50)"


@query(_W + f""", {_TOP}, p AS (SELECT case_key, list({{'m': make, 'o': model, 'r': registration}} ORDER BY sequence, part, supp, price) AS ps FROM parties GROUP BY 1),
e AS (SELECT case_key, string_agg(make, ';' ORDER BY sequence, make) AS events FROM parties WHERE sequence <= 2 GROUP BY 1)
SELECT t.case_key, coalesce(array_to_string(list_transform(ps, lambda x: x.m || '/' || x.o || '/' || x.r), ';'), '') AS parties, coalesce(events, '') AS events FROM top t LEFT JOIN p USING (case_key) LEFT JOIN e USING (case_key)""")
def case_nested(spark, d):
    said = F.array_join(F.transform("parties", lambda p: F.concat_ws("/", p["make"], p["model"], p["registration"])), ";")
    return _nested(spark, d).select("case_key", said.alias("parties"), F.array_join("events", ";").alias("events"))


def _line(label, value):
    return f"CASE WHEN coalesce({value}, '') <> '' THEN '{label}: ' || {value} END"


@query(_W + f""", {_TOP}, p AS (SELECT case_key, list({{'m': make, 'o': model, 'r': registration}} ORDER BY sequence, part, supp, price) AS ps FROM parties GROUP BY 1),
e AS (SELECT case_key, string_agg(make, '; ' ORDER BY sequence, make) AS events FROM parties WHERE sequence <= 2 GROUP BY 1)
SELECT t.case_key, concat_ws(chr(10), '[Source: cases | Case: ' || case_number || ']', 'Case: ' || case_number, 'Date: ' || event_date, {_line('Aircraft', "array_to_string(list_reduce(list_transform(ps, lambda x: [x.m || ' ' || x.o]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), '; ')")},
{_line('Registration', "array_to_string(list_transform(ps, lambda x: x.r), '; ')")}, {_line('Location', 'location')}, {_line('City', 'city')}, {_line('State', 'state')}, {_line('Country', 'country_code')}, {_line('Event type', 'event_type')}, {_line('Severity', 'severity')},
'Fatalities: ' || fatalities, 'Total injuries: ' || total_injuries, {_line('Investigation status', 'investigation_status')}, {_line('Probable cause', 'probable_cause')}, {_line('Events', 'events')}) AS text
FROM top t LEFT JOIN p USING (case_key) LEFT JOIN e USING (case_key)""")
def case_context(spark, d):
    return C.case_context(_nested(spark, d))


@query("SELECT strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_synced_at FROM (SELECT o_orderdate AS t FROM orders UNION ALL SELECT l_shipdate FROM lineitem)")
def last_sync(spark, d):
    return C.last_sync(table(spark, d, "orders").select("o_orderdate"), table(spark, d, "lineitem").select("l_shipdate")).select(_at("last_synced_at"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN true WHEN event_id % 10 = 1 THEN true ELSE epoch(TIMESTAMP '2024-01-15 00:00:00') - epoch(date_trunc('second', ts)) > 3600 END AS stale FROM events")
def staleness(spark, d):
    said = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 10 == 1, "soon").otherwise(F.col("ts").cast("string"))
    return table(spark, d, "events").select("event_id", C.is_stale(said, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("stale"))


# merges

#: All customers again under keys moved on by half the greatest: half of them are stored already.
_NEW = "new AS (SELECT c_custkey + (SELECT max(c_custkey) // 2 FROM customer) AS c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'New#' || c_custkey END AS c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 END AS c_acctbal, c_mktsegment FROM customer)"


def _customers(spark, d):
    old = table(spark, d, "customer")
    k = F.col("c_custkey")
    half = old.agg(F.floor(F.max(k) / 2).alias("half"))
    moved = old.crossJoin(F.broadcast(half))  # one row
    new = moved.select((k + F.col("half")).cast(old.schema["c_custkey"].dataType).alias("c_custkey"), F.when(k % 3 > 0, F.concat(F.lit("New#"), k.cast("string"))).alias("c_name"), "c_nationkey", F.when(k % 2 == 0, F.col("c_acctbal") * 2).alias("c_acctbal"), "c_mktsegment")
    return old, new


@query(f"WITH {_NEW} SELECT * FROM new UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new)")
def upsert_overwrite(spark, d):
    return merging.overwrite(*_customers(spark, d), ["c_custkey"])


@query(f"WITH {_NEW} SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM customer o FULL JOIN new n USING (c_custkey)")
def upsert_coalesce(spark, d):
    return merging.fill(*_customers(spark, d), ["c_custkey"])


@query(f"WITH {_NEW} SELECT * FROM customer UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, d):
    return merging.insert_new(*_customers(spark, d), ["c_custkey"])


@query(f"WITH {_NEW} SELECT o.c_custkey, coalesce(nullif(n.c_name, ''), o.c_name) AS c_name, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(nullif(n.c_mktsegment, ''), o.c_mktsegment) AS c_mktsegment FROM customer o LEFT JOIN new n USING (c_custkey)")
def detail_merge(spark, d):
    return merging.merge_detail(*_customers(spark, d), key="c_custkey")


@query("SELECT c_custkey FROM customer n WHERE NOT EXISTS (SELECT 1 FROM customer o WHERE upper('x' || (o.c_custkey + CASE WHEN o.c_custkey % 3 = 0 THEN 1 ELSE 0 END)) = upper('X' || n.c_custkey) AND o.c_custkey <> n.c_custkey)")
def number_conflict(spark, d):
    new, stored = _numbered(spark, d)
    return merging.without_conflicts(new, stored).select(F.col("case_key").alias("c_custkey"))


def _numbered(spark, d):
    """All customers as incoming cases; and as stored ones, of which every third has the next one's number."""
    k = F.col("c_custkey")
    rows = lambda letter, number: table(spark, d, "customer").select(k.alias("case_key"), F.concat(F.lit(letter), number.cast("string")).alias("case_number"))
    return rows("X", k), rows("x", k + F.when(k % 3 == 0, 1).otherwise(0))


@query("SELECT n.k AS case_key FROM (SELECT c_custkey * 2 AS k, 'X' || c_custkey AS number FROM customer) n WHERE NOT EXISTS (SELECT 1 FROM customer o WHERE o.c_custkey = n.k) AND NOT EXISTS (SELECT 1 FROM customer o WHERE o.c_custkey % 3 = 0 AND 'X' || o.c_custkey = n.number)")
def unseen_cases(spark, d):
    new, stored = _numbered(spark, d)
    return merging.unseen(new.withColumn("case_key", F.col("case_key") * 2), stored.withColumn("case_number", F.when(F.col("case_key") % 3 == 0, F.concat(F.lit("x"), F.col("case_key").cast("string"))))).select("case_key")


@query("WITH new AS (SELECT l_orderkey, l_partkey + 1 AS l_partkey, 1 AS l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber = 1) SELECT * FROM new UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new)")
def child_replace(spark, d):
    old = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    new = old.where("l_orderkey % 4 = 0 AND l_linenumber = 1").select("l_orderkey", (F.col("l_partkey") + 1).alias("l_partkey"), F.lit(1).alias("l_linenumber"), "l_quantity")
    return merging.replace_children(old, new, "l_orderkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti(spark, d):
    return chunking.pending(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", None).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0 AND length(text) > 0")
def pending_changed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    stored = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.col("text")).alias("text"))
    return chunking.pending(docs, stored, "doc_id").select("doc_id")


def _claims(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select((k / 50).cast("long").alias("batch"), "event_id", (F.col("user_id") % 37).alias("case_key"), F.when(k % 11 > 0, F.concat(F.when(k % 2 == 0, "n").otherwise("N"), ((k * 7919) % 29).cast("string"))).alias("case_number"))


@query("""WITH RECURSIVE c AS (SELECT event_id // 50 AS batch, event_id, user_id % 37 AS case_key, CASE WHEN event_id % 11 > 0 THEN CASE WHEN event_id % 2 = 0 THEN 'n' ELSE 'N' END || ((event_id * 7919) % 29) END AS case_number, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS i FROM events),
f AS (SELECT DISTINCT batch, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ks, CAST([] AS VARCHAR[]) AS ns, CAST(NULL AS BIGINT) AS kept FROM c
  UNION ALL SELECT batch, i, CASE WHEN ok THEN list_append(ks, k) ELSE ks END, CASE WHEN ok AND n IS NOT NULL THEN list_append(ns, n) ELSE ns END, CASE WHEN ok THEN event_id END
  FROM (SELECT f.batch, c.i, ks, ns, c.case_key AS k, upper(case_number) AS n, event_id, NOT list_contains(ks, c.case_key) AND NOT coalesce(list_contains(ns, upper(case_number)), false) AS ok FROM f JOIN c ON c.batch = f.batch AND c.i = f.i + 1))
SELECT c.batch, c.event_id, c.case_key, c.case_number FROM f JOIN c ON c.event_id = f.kept""")
def batch_dedupe(spark, d):
    return merging.first_claims(_claims(spark, d), ["batch"], "event_id")


@query(ORACLES["batch_dedupe"].replace("event_id // 50", "0").replace("user_id % 37", "(event_id * 31) % 997").replace("% 29)", "% 1009)").replace(" WHERE TRUE", ""))
def whole_dedupe(spark, d):
    """One batch for the whole table, settled in rounds."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select(F.lit(0).alias("batch"), "event_id", ((k * 31) % 997).alias("case_key"), F.when(k % 11 > 0, F.concat(F.when(k % 2 == 0, "n").otherwise("N"), ((k * 7919) % 1009).cast("string"))).alias("case_number"))
    return merging.claims_in_rounds(rows, "event_id")[0]


@query("SELECT DISTINCT doc_id, CASE WHEN quality = 1 THEN 'running' ELSE 'done' END AS state FROM labels WHERE doc_id % 5 <> 0")
def run_delete(spark, d):
    runs = table(spark, d, "labels").select(F.col("doc_id").alias("case_run_id"), (F.col("doc_id") % 5).cast("string").alias("run_id"), F.when(F.col("quality") == 1, "running").otherwise("done").alias("state"))
    tables = {"runs": spark.createDataFrame([("0", "completed"), ("1", "running")], "run_id string, status string"), "case_runs": runs}
    return merging.delete_run(tables, "0")["case_runs"].select(F.col("case_run_id").alias("doc_id"), "state").distinct()


# payloads

@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(trunc(value) AS INT) AS whole FROM events")
def json_alias_extract(spark, d):
    return table(spark, d, "events").select("event_id", values.to_int(values.first_present(F.col("props"), ["$.missing", "$.k"])).alias("k"), values.to_int(F.col("value").cast("string")).alias("whole"))


def _payloads(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("status"),
        F.struct(
            F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey").cast("string")).alias("mkey"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventDate"), F.col("o_orderpriority").alias("highestInjury")).alias("event"),
            F.concat(F.lit(" N"), F.col("o_orderkey").cast("string")).alias("ntsbNumber"), F.round(F.col("o_totalprice") / 100000, 2).cast("string").alias("totalSerious"),
            F.array(F.struct(F.lit("Make").alias("aircraftMake"), F.lit("").alias("aircraftModel")), F.struct(F.lit("").alias("aircraftMake"), F.lit("").alias("aircraftModel"))).alias("aircrafts"),
            F.array(F.struct(F.lit("b").alias("eventTier2Name")), F.struct(F.lit("a").alias("eventTier2Name")), F.struct(F.lit("b").alias("eventTier2Name"))).alias("events"),
        ).alias("r"),
    )
    return rows.select("ordinal", F.to_json(F.struct(F.struct(F.array("r").alias("records"), F.col("status").alias("nextMarker")).alias("data"))).alias("payload"))


@query("""SELECT o_orderkey AS ordinal, CAST(CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey END AS VARCHAR) AS case_key, 'N' || o_orderkey AS case_number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date, o_orderpriority AS severity,
CAST(trunc(round(o_totalprice / 100000, 2)) AS INT) AS serious_injuries, CAST(nullif(CAST(trunc(round(o_totalprice / 100000, 2)) AS INT), 0) AS VARCHAR) AS total_injuries, o_orderstatus AS marker, 'b;a' AS events, CAST(1 AS INT) AS parties FROM orders""")
def payload_cases(spark, d):
    fields = ("case_key", "case_number", "event_date", "severity", "serious_injuries", "minor_injuries", "total_injuries", "marker", "events", "parties")
    typed = normalizing.cases(normalizing.records(_payloads(spark, d), fields=fields))
    return typed.select("ordinal", *_texts("case_key"), "case_number", *_texts("event_date"), "severity", "serious_injuries", *_texts("total_injuries"), "marker", F.array_join("events", ";").alias("events"), F.size("parties").alias("parties"))


@query("SELECT o_orderkey AS case_key, CAST(s AS INT) AS sequence, t AS text FROM orders, (VALUES (1, 'b'), (2, 'a')) v(s, t) WHERE o_orderkey % 10 > 0")
def payload_children(spark, d):
    return normalizing.children(normalizing.cases(normalizing.records(_payloads(spark, d), fields=("case_key", "events"))), "events")


@query("SELECT CAST(count(*) FILTER (o_orderkey % 10 > 0) AS BIGINT) AS accepted, CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS rejected FROM orders")
def payload_rejects(spark, d):
    typed = normalizing.cases(normalizing.records(_payloads(spark, d), fields=("case_key",)))
    return typed.agg(F.count("case_key").alias("accepted"), F.count_if(F.col("case_key").isNull()).alias("rejected"))


# control

_ACC, _DOC, _SUB = ("thre", "ther"), ("thth", "than"), ("the", "der ", "les ")
_HAS = lambda words: "regexp_matches(lower(text), '" + "|".join(words) + "')"


@query(f"SELECT conv_id, turn, CASE WHEN {_HAS(_ACC)} AND {_HAS(_DOC)} THEN 'both' WHEN {_HAS(_ACC)} THEN 'accidents' WHEN {_HAS(_DOC)} OR {_HAS(_SUB)} THEN 'documents' ELSE 'abstain' END AS route FROM conversations")
def route_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", control.route(F.col("text"), _ACC, _DOC, _SUB).alias("route"))


@query(f"SELECT conv_id, turn, {_HAS(('thre', 'than'))} AND NOT {_HAS(('count', 'ther'))} AS detail FROM conversations")
def detail_policy(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", control.wants_detail(F.col("text"), ("thre", "than"), ("count", "ther")).alias("detail"))


@query("SELECT conv_id, turn, turn % 3 = 0 AS abstained, CASE WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN 'empty' WHEN contains(lower(text), 'thre') AND turn % 3 > 0 THEN 'leak' END AS error FROM conversations")
def abstain_flag(spark, d):
    said = F.when(F.col("turn") % 3 == 0, F.lit(" I don't have that information in my sources. ")).when((F.col("turn") % 3 == 1) & (F.col("conv_id") % 2 == 0), F.lit("  ")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", control.abstained(said).alias("abstained"), control.output_error(said, ("thre",)).alias("error"))


@query("SELECT conv_id, array_to_string(list_filter(['DOC-001', printf('DOC-%03d', turn), 'DOC-009'], lambda i: list_contains(['DOC-001', 'DOC-002'], i)), ',') AS used FROM conversations")
def citation_check(spark, d):
    cited = F.array(F.lit("DOC-001"), control.evidence_id("DOC", F.col("turn")), F.lit("DOC-009"))
    return table(spark, d, "conversations").select("conv_id", F.array_join(control.valid_citations(cited, F.array(F.lit("DOC-001"), F.lit("DOC-002"))), ",").alias("used"))


@query("""WITH e AS (SELECT o_custkey AS q, o_orderkey AS o, CASE WHEN o_orderkey % 2 = 0 THEN printf('ABC%02dXY%03d', o_orderkey % 100, o_orderkey % 1000) ELSE CAST(o_orderkey % 40 AS VARCHAR) END AS who, o_orderpriority LIKE '%URGENT%' AS bare FROM orders WHERE o_custkey % 3 = 0),
f AS (SELECT q, who, min(o) AS o FROM e WHERE bare OR regexp_matches(who, '[A-Z]{3}') GROUP BY 1, 2) SELECT q AS question_id, o AS ordinal, who AS identifier FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY o, who) <= 3""")
def detail_requests(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("question_id"), F.when(F.col("o_custkey") % 3 == 0, "why did it happen").when(F.col("o_custkey") % 3 == 1, "how many, and why").otherwise("where").alias("question"), k.alias("ordinal"),
        F.when(k % 2 == 0, F.format_string("ABC%02dXY%03d", k % 100, k % 1000)).alias("case_number"), (k % 40).alias("case_key"), F.lit("r").alias("record_id"),
        F.when(F.contains("o_orderpriority", F.lit("URGENT")), "Probable cause: unknown").otherwise("Probable cause: ice").alias("text"),
    )
    return C.detail_requests(rows)


@query("SELECT conv_id, turn, printf('DOC-%03d', row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)) AS evidence_id FROM conversations")
def evidence_ids(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    return C.shaped_evidence(rows, "DOC", [F.desc("turn")], ["conv_id"])


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(CAST(CAST(ts AS DATE) - INTERVAL 10 YEAR AS DATE) AS VARCHAR) AS since FROM events")
def years_before(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").select("event_id", day.cast("string").alias("day"), values.years_before(day, 10).cast("string").alias("since"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[\\x00-\\x08]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS url FROM pages")
def control_characters(spark, d):
    noisy = F.concat(F.lit("  \u0001"), F.substring("url", 1, 3), F.lit("\u200b"), F.expr("substring(url, 4)"), F.lit("\u202e "))
    return table(spark, d, "pages").select("page_id", texts.strip(texts.without_controls(noisy)).alias("url"))


@query("""SELECT doc_id AS row, CASE WHEN doc_id % 2 = 0 THEN 'wiki' ELSE 'pdf' END AS source, 'data/raw/' || CASE WHEN doc_id % 2 = 0 THEN 'wiki' ELSE 'pdf_to_txt' END || '/Doc ' || doc_id || '.txt' AS source_file,
CASE WHEN doc_id % 4 = 0 THEN 'id' || doc_id ELSE substr(sha256(CASE WHEN doc_id % 2 = 0 THEN 'wiki' ELSE 'pdf_to_txt' END || '/Doc ' || doc_id || '.txt'), 1, 16) END AS document_id, CAST((length(text) + 3) // 4 AS BIGINT) AS token_count FROM documents""")
def metadata_fill(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(
        F.col("doc_id").alias("row"), F.format_string("Doc %d", "doc_id").alias("name"), F.when(F.col("doc_id") % 2 == 0, "wiki").otherwise("pdf").alias("source"), F.lit(None).cast("string").alias("document_id"),
        F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("long").alias("token_count"), "text",
    )
    manifest = docs.where("doc_id % 4 = 0").select(F.format_string("data/raw/wiki/Doc %d.txt", "doc_id").alias("path"), F.format_string("id%d", "doc_id").alias("document_id"))
    return retrieval.fill_metadata(rows, manifest).drop("text", "name")


# streams


def _feed(spark, d):
    """Events twice over, as a stream read from files."""
    from corvane.streaming import feed

    schema = table(spark, d, "events").schema
    read = lambda: spark.readStream.schema(schema).format("parquet").load(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    return feed, read().union(read())


def _shared(spark) -> str:
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="corvane-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id FROM events")
def stream_dedupe(spark, d):
    feed, stream = _feed(spark, d)
    path = _shared(spark)
    run = feed.deduped(stream, ["event_id"], "ts").select("event_id", "user_id").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, d):
    from corvane.sources.store import Store

    feed, stream = _feed(spark, d)
    path = _shared(spark)
    store = Store(spark, f"{path}/store")
    feed.upsert_stream(stream.select("user_id", "ts", "event_id"), store, "latest", ["user_id"], ["ts", "event_id"], f"{path}/state").awaitTermination()
    return store.read("latest").select("user_id", _at("ts"), "event_id")
