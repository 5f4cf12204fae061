"""The fixture tables in the shapes that operators read, in DataFrames and in SQL.

Children are all documents and all embeddings, met by id: one without the other has no vector or no
text. Four make a parent; parents are documents of that number. Cases are orders, their parties line items. Evaluation cases, runs and measures are
read out of events: run user_id % 8, case event_id % 100, measure event_type, score value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import table

WORDS = "thre ther thth"


def children(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", "embedding").join(docs, "chunk_id", "full_outer")
    return rows.select("chunk_id", (F.col("chunk_id") / 4).cast("long").alias("parent_id"), "label", "embedding", "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The first turn of every conversation: its terms, and the embedding of the same number."""
    from corvane.functions import lexical

    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    said = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("query"), lexical.terms(F.col("text")).alias("terms"))
    return said.join(vectors, "query", "left")


def parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), "text")


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The embedding of vec_id 0."""
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


CHILDREN = """children AS (SELECT coalesce(vec_id, doc_id) AS chunk_id, coalesce(vec_id, doc_id) // 4 AS parent_id, label, CAST(embedding AS DOUBLE[]) AS embedding, text
  FROM embeddings FULL JOIN documents ON doc_id = vec_id)"""
QUERY = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"
TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 0)"


QUESTIONS = f"questions AS (SELECT conv_id AS query, list_distinct({TERMS.format('text')}) AS terms, CAST(embedding AS DOUBLE[]) AS v FROM conversations LEFT JOIN embeddings ON vec_id = conv_id WHERE turn = 0)"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Ranked lists per source: longest documents first; parents are tens of documents."""
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents")
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return docs.select(F.col("source").alias("case_id"), rank.alias("rank"), F.col("doc_id").cast("string").alias("item_id"), (F.col("doc_id") / 10).cast("long").cast("string").alias("parent_id"), ((F.col("n_chars") + 3) / 4).cast("long").alias("token_count"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Judgements: quality plus toxic plus one for a known label, 1 to 3, per document's source."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    labels = table(spark, d, "labels").join(docs, "doc_id")
    return labels.select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("item_id"), (F.col("quality") + F.col("toxic") + 1).alias("relevance"))


RANKED = """ranked AS (SELECT source AS case_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, CAST(doc_id AS VARCHAR) AS item_id,
  CAST(doc_id // 10 AS VARCHAR) AS parent_id, CAST((n_chars + 3) // 4 AS BIGINT) AS token_count FROM documents)"""
JUDGED = "judged AS (SELECT d.source AS case_id, CAST(l.doc_id AS VARCHAR) AS item_id, l.quality + l.toxic + 1 AS relevance FROM labels l JOIN documents d USING (doc_id))"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores by run, case and measure; details hold the greatest k as qrels_count."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    names = {"click": "mrr", "error": "duplicate_ratio", "purchase": "recall_at_5", "signup": "retrieved_tokens", "view": "ndcg_at_5"}
    name = F.col("event_type")
    mapped = F.lit(None).cast("string")
    for a, b in names.items():
        mapped = F.when(name == a, b).otherwise(mapped)
    rows = e.select((F.col("user_id") % 8).cast("string").alias("run_id"), F.format_string("c%02d", F.col("event_id") % 100).alias("case_id"), mapped.alias("metric_name"), "value", k.alias("k"))
    out = rows.groupBy("run_id", "case_id", "metric_name").agg(F.avg("value").alias("score"), F.max("k").alias("k"))
    details = F.to_json(F.struct((F.col("k") % 5).alias("qrels_count")))
    return out.select("run_id", "case_id", "metric_name", "score", details.alias("details"), F.lit("v1").alias("evaluator_version"))


def case_runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per run and case: the events' sums and means; cost is unknown where no purchase was made."""
    e = table(spark, d, "events").withColumns({"run_id": (F.col("user_id") % 8).cast("string"), "case_id": F.format_string("c%02d", F.col("event_id") % 100)})
    k = F.get_json_object("props", "$.k").try_cast("int")
    out = e.groupBy("run_id", "case_id").agg(
        F.avg("value").alias("latency_ms"), F.count("*").alias("retrieved_count"), F.sum(k).cast("long").alias("input_tokens"), F.max(k).cast("long").alias("output_tokens"), F.min(k).cast("long").alias("context_tokens"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("estimated_cost"), (F.count_if(F.col("event_type") == "error") > F.count_if(F.col("event_type") == "view")).alias("abstained"), F.max(F.col("event_id")).alias("case_run_id"),
    )
    top_k = F.when(F.col("run_id") == "3", F.col("retrieved_count") % 3 + 1).otherwise(F.col("run_id").cast("int") + 1)
    return out.withColumn("raw_output", F.to_json(F.struct(F.struct(top_k.cast("int").alias("top_k")).alias("metadata"))))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Eight runs of two data sets, started with their first event; 1 is running, 0 and 4 are baselines."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("r")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    r = F.col("r")
    return e.select(
        r.cast("string").alias("run_id"), (r % 2).cast("string").alias("dataset_id"), F.concat(F.lit("run "), r.cast("string")).alias("run_name"), F.when(r % 4 == 0, "baseline").otherwise("experiment").alias("run_type"),
        F.when(r == 1, "running").otherwise("completed").alias("status"), "started_at", "ended_at", F.when(r < 4, "corpus1").otherwise("corpus2").alias("corpus_version"), F.when(r > 2, "p2").alias("prompt_version"),
        F.when(r == 2, '{"top_k": 7, "secret": 1}').otherwise('{"secret": 1}').alias("config"), F.lit('{"generator_model": "g", "key": "k"}').alias("model_versions"),
    )


def cases(spark: SparkSession, d: str) -> DataFrame:
    """A hundred evaluation cases of two data sets; every tenth is rejected."""
    n = F.col("n")
    e = table(spark, d, "events").select((F.col("event_id") % 100).alias("n")).distinct()
    return e.select(
        F.format_string("c%02d", n).alias("case_id"), (n % 2).cast("string").alias("dataset_id"), F.concat(F.lit("question "), n.cast("string")).alias("question"), (n % 7 != 0).alias("answerable"),
        F.when(n % 5 != 0, F.concat(F.lit("a"), (n % 3).cast("string"))).alias("aircraft"), F.lit(None).cast("string").alias("variant"), F.concat(F.lit("cat"), (n % 4).cast("string")).alias("category"),
        F.when(n % 3 == 0, "hard").otherwise("easy").alias("difficulty"), F.lit("test").alias("split"), F.when(n % 10 == 9, "rejected").otherwise("approved").alias("status"),
    )


METRICS = """metrics AS (SELECT CAST(user_id % 8 AS VARCHAR) AS run_id, printf('c%02d', event_id % 100) AS case_id,
  CASE event_type WHEN 'click' THEN 'mrr' WHEN 'error' THEN 'duplicate_ratio' WHEN 'purchase' THEN 'recall_at_5' WHEN 'signup' THEN 'retrieved_tokens' WHEN 'view' THEN 'ndcg_at_5' END AS metric_name,
  avg(value) AS score, max(TRY_CAST(json_extract_string(props, '$.k') AS INT)) % 5 AS qrels, 'v1' AS evaluator_version FROM events GROUP BY 1, 2, 3)"""
CASE_RUNS = """case_runs AS (SELECT run_id, case_id, avg(value) AS latency_ms, count(*) AS retrieved_count, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(max(k) AS BIGINT) AS output_tokens, CAST(min(k) AS BIGINT) AS context_tokens,
  sum(value) FILTER (event_type = 'purchase') AS estimated_cost, count(*) FILTER (event_type = 'error') > count(*) FILTER (event_type = 'view') AS abstained, max(event_id) AS case_run_id,
  CAST(CASE WHEN run_id = '3' THEN count(*) % 3 + 1 ELSE CAST(run_id AS INT) + 1 END AS INT) AS raw_k
  FROM (SELECT *, CAST(user_id % 8 AS VARCHAR) AS run_id, printf('c%02d', event_id % 100) AS case_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY run_id, case_id)"""
RUNS = """runs AS (SELECT CAST(r AS VARCHAR) AS run_id, CAST(r % 2 AS VARCHAR) AS dataset_id, 'run ' || r AS run_name, CASE WHEN r % 4 = 0 THEN 'baseline' ELSE 'experiment' END AS run_type,
  CASE WHEN r = 1 THEN 'running' ELSE 'completed' END AS status, started_at, ended_at, CASE WHEN r < 4 THEN 'corpus1' ELSE 'corpus2' END AS corpus_version, CASE WHEN r > 2 THEN 'p2' END AS prompt_version,
  CASE WHEN r = 2 THEN 7 END AS config_k FROM (SELECT user_id % 8 AS r, min(ts) AS started_at, max(ts) AS ended_at FROM events GROUP BY 1))"""
CASES = """cases AS (SELECT printf('c%02d', n) AS case_id, CAST(n % 2 AS VARCHAR) AS dataset_id, 'question ' || n AS question, n % 7 <> 0 AS answerable, CASE WHEN n % 5 <> 0 THEN 'a' || (n % 3) END AS aircraft,
  CAST(NULL AS VARCHAR) AS variant, 'cat' || (n % 4) AS category, CASE WHEN n % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty, 'test' AS split, CASE WHEN n % 10 = 9 THEN 'rejected' ELSE 'approved' END AS status
  FROM (SELECT DISTINCT event_id % 100 AS n FROM events))"""


def incidents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases: deaths from the price (null for some), severity from the priority, place from the nation."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # nations and regions are fixed tables
    deaths = F.floor(F.col("o_totalprice") / 50000).cast("int")
    return rows.select(
        F.col("o_orderkey").alias("case_key"), F.format_string("ABC%02dXY%03d", F.col("o_orderkey") % 100, F.col("o_orderkey") % 1000).alias("case_number"), F.to_date("o_orderdate").alias("event_date"),
        F.col("n_name").alias("city"), F.col("r_name").alias("location"), F.col("r_name").alias("state"), F.col("r_name").alias("country"), F.upper(F.substring("r_name", 1, 2)).alias("country_code"),
        F.col("c_mktsegment").alias("event_type"), F.col("o_orderpriority").alias("severity"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("investigation_status"),
        F.when(deaths > 1, deaths).alias("fatalities"), F.when(F.col("o_orderkey") % 3 > 0, deaths + 1).alias("total_injuries"),
        F.lit(None).cast("string").alias("narrative"), F.col("c_name").alias("probable_cause"), F.lit(None).cast("string").alias("airport"), F.lit(None).cast("string").alias("runway"),
    )


def parties(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = li.join(p, li.l_partkey == p.p_partkey)
    return rows.select(F.col("l_orderkey").alias("case_key"), F.col("l_linenumber").alias("sequence"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.concat(F.lit("N"), F.col("l_suppkey").cast("string")).alias("registration"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"))


INCIDENTS = """incidents AS (SELECT o_orderkey AS case_key, printf('ABC%02dXY%03d', o_orderkey % 100, o_orderkey % 1000) AS case_number, CAST(o_orderdate AS DATE) AS event_date, n_name AS city, r_name AS location, r_name AS state,
  r_name AS country, upper(substr(r_name, 1, 2)) AS country_code, c_mktsegment AS event_type, o_orderpriority AS severity, nullif(o_orderstatus, 'P') AS investigation_status,
  CASE WHEN floor(o_totalprice / 50000) > 1 THEN CAST(floor(o_totalprice / 50000) AS INT) END AS fatalities, CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice / 50000) AS INT) + 1 END AS total_injuries, c_name AS probable_cause
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PARTIES = """parties AS (SELECT l_orderkey AS case_key, l_linenumber AS sequence, p_brand AS make, p_type AS model, 'N' || l_suppkey AS registration, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
