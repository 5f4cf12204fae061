"""Queries on retrieval, texts and ranking measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import lexical, text
from corvane.operators import chunking, codes, indexing, metrics, retrieval, searching
from corvane.plans import fixtures as X
from corvane.session import table, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_WANTED = "['thre', 'ther', 'thth']"
_T = X.TERMS.format("text")
_LEGS = f"""WITH {X.CHILDREN}, {X.QUERY},
vec AS (SELECT parent_id, row_number() OVER (ORDER BY d NULLS LAST, parent_id) AS rnk FROM (SELECT parent_id, min(1 - list_cosine_similarity(embedding, v)) AS d FROM children, q WHERE embedding IS NOT NULL GROUP BY 1) QUALIFY rnk <= 30),
hit AS (SELECT parent_id, chunk_id, len(list_filter({_T}, lambda t: list_contains({_WANTED}, t))) AS s FROM children),
kw AS (SELECT parent_id, row_number() OVER (ORDER BY s DESC, parent_id) AS rnk FROM (SELECT parent_id, max(s) AS s FROM hit WHERE s > 0 GROUP BY 1) QUALIFY rnk <= 30),
f AS (SELECT parent_id, coalesce(max(1.0::DOUBLE / (60 + v)), 0) + coalesce(max(1.0::DOUBLE / (60 + k)), 0) AS score, max(v) AS v, max(k) AS k FROM (SELECT parent_id, rnk AS v, NULL AS k FROM vec UNION ALL SELECT parent_id, NULL, rnk FROM kw) GROUP BY 1)"""


@query(_LEGS + """ SELECT f.parent_id, round(score, 6) AS rrf_score, CAST(v AS INT) AS vector_rank, CAST(k AS INT) AS keyword_rank, d.text FROM f JOIN documents d ON d.doc_id = f.parent_id ORDER BY score DESC, f.parent_id LIMIT 5""")
def hybrid_rrf(spark, d):
    found = retrieval.hybrid(X.children(spark, d), X.parents(spark, d), X.query_vector(spark, d), X.WORDS)
    return found.withColumn("rrf_score", F.round("rrf_score", 6))


@query(_LEGS + """, top AS (SELECT f.* FROM f JOIN documents d ON d.doc_id = f.parent_id ORDER BY score DESC, f.parent_id LIMIT 20)
SELECT count(*) FILTER (v IS NOT NULL AND k IS NOT NULL) AS both, count(*) FILTER (v IS NOT NULL AND k IS NULL) AS only_vector, count(*) FILTER (k IS NOT NULL AND v IS NULL) AS only_keyword FROM top""")
def hybrid_verdict(spark, d):
    return retrieval.verdict(retrieval.hybrid(X.children(spark, d), X.parents(spark, d), X.query_vector(spark, d), X.WORDS, k=20))


@query(f"WITH {X.CHILDREN}, {X.QUERY} SELECT chunk_id, parent_id, label, round(list_cosine_similarity(embedding, v), 6) AS similarity FROM children, q WHERE embedding IS NOT NULL ORDER BY list_cosine_similarity(embedding, v) DESC, chunk_id LIMIT 10")
def vector_topk(spark, d):
    found = retrieval.nearest(X.children(spark, d), X.query_vector(spark, d), 10)
    return found.select("chunk_id", "parent_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {X.CHILDREN}, {X.QUERY} SELECT chunk_id, parent_id, label, round(list_cosine_similarity(embedding, v), 6) AS similarity FROM children, q WHERE label = 3 ORDER BY list_cosine_similarity(embedding, v) DESC, chunk_id LIMIT 10")
def vector_topk_filtered(spark, d):
    found = retrieval.nearest(X.children(spark, d), X.query_vector(spark, d), 10, F.col("label") == 3)
    return found.select("chunk_id", "parent_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {X.CHILDREN}, {X.QUERY}, s AS (SELECT parent_id, chunk_id, 1 - list_cosine_similarity(embedding, v) AS d FROM children, q WHERE embedding IS NOT NULL AND parent_id IN (SELECT doc_id FROM documents)),
b AS (SELECT parent_id, chunk_id, d FROM s QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY d, chunk_id) = 1 ORDER BY d, parent_id LIMIT 5)
SELECT b.parent_id, b.chunk_id, round(1 - b.d, 6) AS similarity, t.text FROM b JOIN documents t ON t.doc_id = b.parent_id""")
def vector_parent_topk(spark, d):
    found = retrieval.nearest_parents(X.children(spark, d), X.parents(spark, d), X.query_vector(spark, d))
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {X.CHILDREN}, {X.QUERY},
vec AS (SELECT 'vector' AS leg, parent_id, chunk_id, list_cosine_similarity(embedding, v) AS s FROM children, q WHERE embedding IS NOT NULL ORDER BY s DESC, chunk_id LIMIT 10),
kw AS (SELECT 'keyword' AS leg, parent_id, chunk_id, CAST(len(list_filter({_T}, lambda t: list_contains({_WANTED}, t))) AS DOUBLE) AS s FROM children WHERE len(list_filter({_T}, lambda t: list_contains({_WANTED}, t))) > 0 ORDER BY s DESC, chunk_id LIMIT 10),
r AS (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY s DESC, chunk_id) AS rnk FROM (SELECT * FROM vec UNION ALL SELECT * FROM kw))
SELECT leg, parent_id, CAST(min(rnk) AS INT) AS rnk, round(arg_min(s, rnk), 6) AS score FROM r GROUP BY leg, parent_id""")
def hybrid_leg_debug(spark, d):
    found = retrieval.best_rank(retrieval.leg_children(X.children(spark, d), X.query_vector(spark, d), lexical.query_terms(X.WORDS)))
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, CAST(len(list_filter({_T}, lambda t: list_contains({_WANTED}, t))) AS BIGINT) AS hits FROM documents WHERE len(list_filter({_T}, lambda t: list_contains({_WANTED}, t))) > 0")
def keyword_or(spark, d):
    rows = table(spark, d, "documents").withColumn("terms", lexical.terms(F.col("text")))
    wanted = lexical.query_terms(X.WORDS)
    return rows.where(lexical.matches_any(F.col("terms"), wanted)).select("doc_id", lexical.term_count(F.col("terms"), wanted).alias("hits"))


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_T}, ['of', 'the', 'thre'])")
def keyword_and(spark, d):
    rows = table(spark, d, "documents")
    return rows.where(lexical.matches_all(lexical.terms(F.col("text")), lexical.query_terms("The thre of"))).select("doc_id")


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
_PARAS = f"list_filter(list_transform(string_split({_CLEAN.format('text')}, chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) > 0)"


@query(f"SELECT doc_id, {_CLEAN.format('text')} AS text FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS token_count FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("token_count"))


@query(f"SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS number, unnest(p) AS paragraph FROM (SELECT doc_id, {_PARAS} AS p FROM documents)")
def split_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.split_paragraphs(text.clean_text(F.col("text")), "\n")).alias("number", "paragraph"))


@query("""SELECT doc_id, CAST(s // 400 AS INT) AS number, substr(text, s + 1, 500) AS child FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 400)) AS s FROM documents WHERE length(text) > 0)
WHERE s = 0 OR s + 100 < length(text)""")
def child_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.child_windows(F.col("text"))).alias("number", "child"))


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, {_PARAS} AS ps FROM documents),
fold AS (SELECT doc_id, ps, 1 AS i, 0 AS parent, length(ps[1]) AS size FROM p WHERE len(ps) > 0
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN size + length(ps[i + 1]) > 2000 THEN parent + 1 ELSE parent END, CASE WHEN size + length(ps[i + 1]) > 2000 THEN length(ps[i + 1]) ELSE size + length(ps[i + 1]) END FROM fold WHERE i < len(ps))
SELECT doc_id, CAST(parent AS INT) AS number, string_agg(ps[i], chr(10) ORDER BY i) AS parent FROM fold GROUP BY doc_id, fold.parent""")
def parent_pack(spark, d):
    paragraphs = text.split_paragraphs(text.clean_text(F.col("text")), "\n")
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.pack_paragraphs(paragraphs, mark="\n")).alias("number", "parent"))


@query(f"""WITH parents AS (SELECT * FROM ({ORACLES['parent_pack']})), c AS (SELECT doc_id, number AS parent, s, substr(parent, s + 1, 500) AS text FROM (SELECT doc_id, number, parent, unnest(generate_series(0, greatest(length(parent) - 1, 0), 400)) AS s FROM parents WHERE length(parent) > 0) WHERE s = 0 OR s + 100 < length(parent)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY parent, s) - 1 AS number FROM c)
SELECT printf('doc%05d_%s_c%03d', doc_id, source, number) AS chunk_id, printf('doc%05d_%s_p%03d', doc_id, source, parent) AS parent_id, printf('doc%05d', doc_id) AS name, source, n.text, substr(sha256(source || '/' || doc_id || '.txt'), 1, 16) AS document_id,
'data/raw/' || source || '/' || doc_id || '.txt' AS source_file, CAST((length(n.text) + 3) // 4 AS BIGINT) AS token_count FROM n JOIN documents USING (doc_id)""")
def chunked_corpus(spark, d):
    docs = table(spark, d, "documents").select(F.format_string("doc%05d", "doc_id").alias("name"), "source", F.format_string("data/raw/%s/%d.txt", "source", "doc_id").alias("path"), "text")
    return chunking.chunks(docs, mark="\n")


@query("SELECT doc_id, substr(sha256(source || '/' || doc_id || '.txt'), 1, 16) AS document_id, printf('doc%d_%s_p%03d', doc_id, source, doc_id % 1000) AS parent_id FROM documents")
def provenance_hash(spark, d):
    path = F.concat(F.lit("data/raw/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    pid = text.parent_id(F.concat(F.lit("Doc"), F.col("doc_id").cast("string")), F.col("source"), F.col("doc_id") % 1000)
    return table(spark, d, "documents").select("doc_id", text.document_id(path).alias("document_id"), pid.alias("parent_id"))


@query("SELECT doc_id, source, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, source, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 16000")
def context_budget(spark, d):
    found = retrieval.context_budget(table(spark, d, "documents"), [F.col("doc_id")], ["source"])
    return found.select("doc_id", "source", "running")


_SCORES = f"""WITH {X.RANKED}, {X.JUDGED}, hit AS (SELECT r.case_id, r.rank, j.relevance FROM ranked r JOIN judged j USING (case_id, item_id)),
n AS (SELECT case_id, count(*) FILTER (relevance >= 2) AS relevant FROM judged GROUP BY 1), c AS (SELECT DISTINCT case_id FROM ranked)"""


def _scored(spark, d):
    return metrics.relevance_scores(X.ranked(spark, d), X.judged(spark, d))


@query(_SCORES + """ SELECT c.case_id, """ + ", ".join(f"""CASE WHEN coalesce(max(relevant), 0) > 0 THEN count(*) FILTER (relevance >= 2 AND rank <= {k})::DOUBLE / max(relevant) ELSE 1.0 END AS recall_at_{k}, count(*) FILTER (relevance >= 2 AND rank <= {k})::DOUBLE / {k} AS precision_at_{k},
CASE WHEN count(*) FILTER (relevance >= 2 AND rank <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate_at_{k}""" for k in (3, 5, 10)) + " FROM c LEFT JOIN hit USING (case_id) LEFT JOIN n USING (case_id) GROUP BY c.case_id")
def recall_precision_hit(spark, d):
    return _scored(spark, d).select("case_id", *(f"{m}_at_{k}" for k in (3, 5, 10) for m in ("recall", "precision", "hit_rate")))


@query(_SCORES + " SELECT c.case_id, coalesce(1.0::DOUBLE / min(rank) FILTER (relevance >= 2), 0) AS mrr FROM c LEFT JOIN hit USING (case_id) GROUP BY c.case_id")
def mrr(spark, d):
    return _scored(spark, d).select("case_id", "mrr")


@query(_SCORES + """, i AS (SELECT case_id, relevance, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, item_id) AS pos FROM judged),
g AS (SELECT case_id, """ + ", ".join(f"sum((pow(2, relevance) - 1) / log2(pos + 1)) FILTER (pos <= {k}) AS i{k}" for k in (3, 5, 10)) + """ FROM i GROUP BY 1), h AS (SELECT case_id, """ + ", ".join(f"sum((pow(2, relevance) - 1) / log2(rank + 1)) FILTER (rank <= {k}) AS d{k}" for k in (3, 5, 10)) + """ FROM hit GROUP BY 1)
SELECT c.case_id, """ + ", ".join(f"round(CASE WHEN coalesce(i{k}, 0) > 0 THEN coalesce(d{k}, 0) / i{k} ELSE 1.0 END, 6) AS ndcg_at_{k}" for k in (3, 5, 10)) + " FROM c LEFT JOIN g USING (case_id) LEFT JOIN h USING (case_id)")
def ndcg(spark, d):
    return _scored(spark, d).select("case_id", *(F.round(f"ndcg_at_{k}", 6).alias(f"ndcg_at_{k}") for k in (3, 5, 10)))


@query(f"WITH {X.RANKED} SELECT case_id, count(DISTINCT parent_id)::DOUBLE / count(*) AS unique_parent_ratio, 1 - count(DISTINCT parent_id)::DOUBLE / count(*) AS duplicate_ratio FROM ranked GROUP BY 1")
def unique_parent_ratio(spark, d):
    return metrics.list_scores(X.ranked(spark, d)).select("case_id", "unique_parent_ratio", "duplicate_ratio")


@query(f"WITH {X.RANKED} SELECT case_id, count(*) AS retrieved_items, CAST(sum(token_count) AS BIGINT) AS retrieved_tokens FROM ranked GROUP BY 1")
def retrieved_tokens(spark, d):
    return metrics.list_scores(X.ranked(spark, d)).select("case_id", "retrieved_items", "retrieved_tokens")


@query("SELECT CAST(doc_id % 50 AS VARCHAR) AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'd' || (doc_id % 20) ELSE 'p' || (doc_id % 20) END AS item_id, max(quality + 2 * toxic) AS relevance FROM labels GROUP BY 1, 2")
def qrels_max(spark, d):
    k = (F.col("doc_id") % 20).cast("string")
    evidence = table(spark, d, "labels").select(
        (F.col("doc_id") % 50).cast("string").alias("case_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), k)).alias("document_id"), F.concat(F.lit("p"), k).alias("parent_id"), F.lit("c").alias("chunk_id"), (F.col("quality") + 2 * F.col("toxic")).alias("relevance"),
    )
    return metrics.qrels(evidence)


_MEASURES = [f"{m}_at_{k}" for k in (3, 5, 10) for m in ("recall", "precision", "hit_rate", "ndcg")] + ["mrr", "unique_parent_ratio", "duplicate_ratio", "retrieved_items", "retrieved_tokens"]


@query("SELECT case_id, metric_name, round(score, 6) AS score FROM (UNPIVOT (SELECT case_id, " + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in _MEASURES) + " FROM " + " JOIN ".join(f"({ORACLES[n]}) {n}_" + (" USING (case_id)" if i else "") for i, n in enumerate(("recall_precision_hit", "mrr", "ndcg", "unique_parent_ratio", "retrieved_tokens"))) + f") ON {', '.join(_MEASURES)} INTO NAME metric_name VALUE score)")
def evaluate_long(spark, d):
    ranked = X.ranked(spark, d)
    return metrics.evaluate(ranked, X.judged(spark, d), cases=ranked).withColumn("score", F.round("score", 6))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS text FROM pages")
def html_escape_context(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("text"))


@query("SELECT conv_id, turn, text, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 1000 THEN 'too long' END AS error FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN repeat(text, 100) WHEN 3 THEN NULL ELSE text END AS text FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations))")
def question_check(spark, d):
    t = F.col("turn") % 4
    said = text.strip(F.col("text"))
    noisy = F.when(t == 0, " \u200b\t ").when(t == 1, F.concat(F.lit("\u0001 "), F.repeat(said, F.lit(100)))).when(t == 2, F.concat(F.lit("\u202e\u200d "), said, F.lit("\u2069\n")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.question(noisy).alias("q"))
    return rows.select("conv_id", "turn", "q.text", "q.error")


@query("SELECT doc_id, CAST(s AS INT) AS start FROM (SELECT doc_id, n_chars, unnest(generate_series(0, greatest(n_chars - 1, 0), 255)) AS s FROM documents) WHERE least(n_chars - s, 510) >= 20")
def classifier_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(chunking.token_windows(F.col("n_chars").cast("int"))).alias("start"))


# stored indexes


_POSTED = f"""WITH {X.CHILDREN}, t AS (SELECT chunk_id, parent_id, {X.TERMS.format("coalesce(text, '')")} AS ts FROM children), s AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM t),
p AS (SELECT chunk_id, parent_id, len(ts) AS size, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM t) GROUP BY ALL), i AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM p)"""


@query(_POSTED + " SELECT term, count(*) AS rows, CAST(sum(tf) AS BIGINT) AS tokens, max(df) AS df FROM i GROUP BY term")
def term_postings(spark, d):
    index = indexing.postings(X.children(spark, d))
    return index.groupBy("term").agg(F.count("*").alias("rows"), F.sum("tf").alias("tokens"), F.max("df").alias("df"))


@query(_POSTED + f""" SELECT chunk_id, parent_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg_len))), 6) AS score FROM i, s WHERE list_contains({_WANTED}, term) GROUP BY 1, 2""")
def postings_bm25(spark, d):
    children = X.children(spark, d)
    found = indexing.keyword_scores(indexing.postings(children), indexing.sizes(children), lexical.query_terms(X.WORDS))
    return found.withColumn("score", F.round("score", 6))


def _enough(queries, exact, found):
    """One row: all queries, those without a neighbour too, and whether enough neighbours are found."""
    told = indexing.recall(exact, found).select((F.coalesce("recall", F.lit(1.0)) >= 0.9).alias("enough"))
    return queries.agg(F.count("*").alias("queries")).crossJoin(told)


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(spark, d):
    """Recall of cells against all rows, for every row whose id is divisible by 20; the target is 0.9."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("v"))
    cells = indexing.learn_cells(rows)
    exact, found = indexing.neighbours(rows, queries), indexing.neighbours(indexing.with_cells(rows, cells), queries, cells=cells)
    return _enough(queries, exact, found)


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_codes_recall(spark, d):
    """Recall of codes with exact ranking of their candidates, against all rows, for every row whose id is divisible by 20; the target is 0.9."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("v"))
    learnt = codes.learn_codes(rows, indexing.learn_cells(rows, target=0.99))
    blocks = written(codes.code_blocks(rows, learnt), "codes")
    found = codes.neighbours(queries, blocks, rows, learnt, codes.candidates_for(learnt, rows.count()))
    return _enough(queries, indexing.neighbours(rows, queries), found)


_WEIGHED = _POSTED.replace("WITH ", f"WITH {X.QUESTIONS}, ", 1) + """, asked AS (SELECT query, unnest(terms) AS term FROM questions),
child AS (SELECT query, chunk_id, parent_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg_len)))), 9) AS score FROM asked JOIN i USING (term), s GROUP BY 1, 2, 3),
kw AS (SELECT query, parent_id, max(score) AS score, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, parent_id) AS rnk FROM child GROUP BY 1, 2 QUALIFY rnk <= 30)"""
_MANY = _WEIGHED + """, near AS (SELECT query, parent_id, round(max(list_cosine_similarity(embedding, v)), 9) AS score FROM children, questions WHERE embedding IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2),
vec AS (SELECT query, parent_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, parent_id) AS rnk FROM near QUALIFY rnk <= 30),
f AS (SELECT query, parent_id, coalesce(max(1.0::DOUBLE / (60 + v)), 0) + coalesce(max(1.0::DOUBLE / (60 + k)), 0) AS score, max(v) AS v, max(k) AS k FROM (SELECT query, parent_id, rnk AS v, NULL AS k FROM vec UNION ALL SELECT query, parent_id, NULL, rnk FROM kw) WHERE parent_id IN (SELECT doc_id FROM documents) GROUP BY 1, 2)"""


def _stored(spark, d, blocks=searching.term_blocks, options=None):
    """Children, the size row and blocks of postings, written to the shared folder as an index is."""
    children = X.children(spark, d)
    stats = written(indexing.sizes(children), "sizes")
    return children, stats, written(blocks(children, stats), "postings", options=options)


@query(_WEIGHED + " SELECT query, parent_id, round(score, 6) AS score, CAST(rnk AS INT) AS rnk FROM kw")
def keyword_questions(spark, d):
    """The keyword leg of every question of the conversations, in one job, over all documents."""
    _, stats, blocks = _stored(spark, d, searching.range_blocks, searching.FILES)
    return searching.keyword_leg_of_many(X.questions(spark, d), blocks, stats).withColumn("score", F.round("score", 6))


@query(_MANY + " SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, parent_id) AS INT) AS rank, parent_id, round(score, 6) AS rrf_score, CAST(v AS INT) AS vector_rank, CAST(k AS INT) AS keyword_rank FROM f QUALIFY rank <= 5")
def hybrid_questions(spark, d):
    """Hybrid search for every question of the conversations, in one job."""
    children, stats, blocks = _stored(spark, d, searching.range_blocks, searching.FILES)
    found = searching.hybrid(X.questions(spark, d), X.parents(spark, d), blocks, stats, written(searching.vector_blocks(children), "vectors"))
    return found.withColumn("rrf_score", F.round("rrf_score", 6))


@query(_MANY.replace(X.QUESTIONS, f"questions AS (SELECT 0 AS query, {_WANTED} AS terms, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)") + " SELECT parent_id, round(score, 6) AS rrf_score, CAST(v AS INT) AS vector_rank, CAST(k AS INT) AS keyword_rank FROM f ORDER BY score DESC, parent_id LIMIT 5")
def hybrid_bm25(spark, d):
    """One question, its keyword leg from stored blocks of postings."""
    children, stats, blocks = _stored(spark, d)
    asked = spark.range(1).select(F.col("id").alias("query"), F.lit(lexical.query_terms(X.WORDS)).alias("terms"))
    keyword = searching.keyword_leg(asked, blocks, stats).select("parent_id", "rnk")
    found = retrieval.hybrid(children, X.parents(spark, d), X.query_vector(spark, d), X.WORDS, keyword=keyword)
    return found.withColumn("rrf_score", F.round("rrf_score", 6)).drop("text")


@query("SELECT doc_id, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY lang, doc_id) AS running FROM documents) WHERE running <= 400000")
def budget_prefix(spark, d):
    """The longest prefix of all documents within a budget, by sums of ranges."""
    found = retrieval.context_budget(table(spark, d, "documents"), [F.col("lang"), F.col("doc_id")], most=400000)
    return found.select("doc_id", "running")
