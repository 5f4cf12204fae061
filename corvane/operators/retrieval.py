"""Nearest-neighbour, keyword and hybrid retrieval over children and their parents.

Tables: children (chunk_id, parent_id, embedding, text and filter columns), parents (parent_id,
text and more). Every ranking ends with a key, so results are total orders. Candidate sets are
cut before they are ranked and fused; parents' texts join last, to at most `candidates` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lexical, text, vector
from corvane.session import written

TOP_K, CANDIDATES, RRF = 5, 30, 60


def _filtered(children: DataFrame, where: Column | None) -> DataFrame:
    return children if where is None else children.where(where)


def nearest(children: DataFrame, query: Sequence[float], k: int = TOP_K, where: Column | None = None) -> DataFrame:
    """The k nearest children by cosine distance: their columns and similarity."""
    scored = _filtered(children, where).where("embedding is not null").withColumn("distance", vector.cosine_distance(F.col("embedding"), query))
    return scored.orderBy(F.asc_nulls_last("distance"), "chunk_id").limit(k).withColumn("similarity", 1 - F.col("distance")).drop("distance")


def nearest_parents(children: DataFrame, parents: DataFrame, query: Sequence[float], k: int = TOP_K, where: Column | None = None) -> DataFrame:
    """The k parents with the nearest best child: parent_id, chunk_id of that child, similarity, text.

    The best child is a struct minimum, combined map-side; orphans drop in the join with parents.
    """
    scored = _filtered(children, where).where("embedding is not null and parent_id is not null")
    scored = scored.select("parent_id", "chunk_id", vector.cosine_distance(F.col("embedding"), query).alias("distance"))
    known = scored.join(parents.select("parent_id"), "parent_id", "left_semi")
    best = known.groupBy("parent_id").agg(F.min(F.struct("distance", "chunk_id")).alias("b")).select("parent_id", "b.*")
    top = best.orderBy(F.asc_nulls_last("distance"), "parent_id").limit(k)
    return top.join(parents, "parent_id").select("parent_id", "chunk_id", (1 - F.col("distance")).alias("similarity"), "text")


def vector_leg(children: DataFrame, query: Sequence[float], candidates: int = CANDIDATES, where: Column | None = None, keep_null: bool = False) -> DataFrame:
    """(parent_id, rnk): parents by their nearest child. keep_null lets parents without embedding rank last."""
    rows = _filtered(children, where).where("parent_id is not null")
    if not keep_null:
        rows = rows.where("embedding is not null")
    best = rows.groupBy("parent_id").agg(F.min(vector.cosine_distance(F.col("embedding"), query)).alias("d"))
    return ranked(best, [F.asc_nulls_last("d"), F.col("parent_id")], candidates)


def keyword_leg(children: DataFrame, wanted: list[str], candidates: int = CANDIDATES, where: Column | None = None, ranking: str = "count") -> DataFrame:
    """(parent_id, rnk): parents by their best child with any wanted term, by count or by BM25."""
    rows = _filtered(children, where).where("parent_id is not null").withColumn("terms", lexical.terms(F.col("text")))
    if ranking == "bm25":
        rows = rows.withColumn("terms", lexical.stemmed("terms"))
        scores = lexical.bm25(rows, "chunk_id", "terms", wanted)
        scored = rows.select("chunk_id", "parent_id").join(scores, "chunk_id")
    else:
        scored = rows.where(lexical.matches_any(F.col("terms"), wanted)).select("parent_id", lexical.term_count(F.col("terms"), wanted).alias("score"))
    best = scored.groupBy("parent_id").agg(F.max("score").alias("s"))
    return ranked(best, [F.desc_nulls_last("s"), F.col("parent_id")], candidates)


def ranked(best: DataFrame, order: list, candidates: int) -> DataFrame:
    # the window sees at most `candidates` rows
    return best.orderBy(*order).limit(candidates).select("parent_id", F.row_number().over(W.orderBy(*order)).alias("rnk"))


def fuse(*legs: DataFrame, constant: int = RRF) -> DataFrame:
    """(parent_id, rrf_score): reciprocal rank fusion (Cormack et al. 2009)."""
    rows = legs[0]
    for leg in legs[1:]:
        rows = rows.unionByName(leg)
    return rows.groupBy("parent_id").agg(F.sum(F.lit(1.0) / (constant + F.col("rnk"))).alias("rrf_score"))


def hybrid(children: DataFrame, parents: DataFrame, query: Sequence[float], words: str, k: int = TOP_K, candidates: int = CANDIDATES, where: Column | None = None, ranking: str = "count", keyword: DataFrame | None = None) -> DataFrame:
    """The k parents with the highest fused score: parent_id, rrf_score, rnk per leg, text.

    Leg ranks are kept, so that what each leg found can be told. keyword, if given, is the keyword leg
    (parent_id, rnk), as from stored postings (operators.searching).
    """
    wanted = lexical.query_terms(words, stem=ranking == "bm25")
    vec = vector_leg(children, query, candidates, where)
    kw = keyword_leg(children, wanted, candidates, where, ranking) if keyword is None else keyword
    rows = vec.select("parent_id", F.col("rnk").alias("vector_rank"), F.lit(None).cast("int").alias("keyword_rank"))
    rows = rows.unionByName(kw.select("parent_id", F.lit(None).cast("int").alias("vector_rank"), F.col("rnk").alias("keyword_rank")))
    part = lambda c: F.coalesce(F.sum(F.lit(1.0) / (RRF + F.col(c))), F.lit(0.0))
    fused = rows.groupBy("parent_id").agg((part("vector_rank") + part("keyword_rank")).alias("rrf_score"), F.max("vector_rank").alias("vector_rank"), F.max("keyword_rank").alias("keyword_rank"))
    joined = fused.join(parents, "parent_id")
    return joined.orderBy(F.desc_nulls_last("rrf_score"), "parent_id").limit(k).select("parent_id", "rrf_score", "vector_rank", "keyword_rank", "text")


def leg_children(children: DataFrame, query: Sequence[float], wanted: list[str], candidates: int = 10) -> DataFrame:
    """Diagnostics: the best children of each leg with rank and score (leg, parent_id, chunk_id, rnk, score)."""
    rows = children.where("parent_id is not null")
    vec = rows.where("embedding is not null").select("parent_id", "chunk_id", (1 - vector.cosine_distance(F.col("embedding"), query)).alias("score"))
    terms = lexical.terms(F.col("text"))
    kw = rows.where(lexical.matches_any(terms, wanted)).select("parent_id", "chunk_id", lexical.term_count(terms, wanted).cast("double").alias("score"))
    order = [F.desc_nulls_last("score"), F.col("chunk_id")]
    out = [leg.orderBy(*order).limit(candidates).select(F.lit(name).alias("leg"), "parent_id", "chunk_id", F.row_number().over(W.orderBy(*order)).alias("rnk"), "score") for name, leg in (("vector", vec), ("keyword", kw))]
    return out[0].unionByName(out[1])


def best_rank(leg: DataFrame) -> DataFrame:
    """Each parent's best-ranked row in a leg."""
    return leg.groupBy("leg", "parent_id").agg(F.min("rnk").alias("rnk"), F.min_by("score", "rnk").alias("score"))


def verdict(found: DataFrame) -> DataFrame:
    """How many of the hybrid's rows both legs, only the vector and only the keyword leg found."""
    v, k = F.col("vector_rank").isNotNull(), F.col("keyword_rank").isNotNull()
    return found.agg(F.count_if(v & k).alias("both"), F.count_if(v & ~k).alias("only_vector"), F.count_if(k & ~v).alias("only_keyword"))


def context_budget(rows: DataFrame, order: list, partition: list[str] | None = None, most: int = 16000) -> DataFrame:
    """The longest prefix of texts whose running length stays within the budget, with `running`; one for each value of
    the partition columns, or of all rows.

    Lengths aren't negative, so a running sum within the budget is exactly the prefix rule. Without a partition
    rows are ordered by ranges and written to the shared folder; sums by range tell which ranges lie before
    the cut, and only these are read again. No task sees more than a range. Rows that tie in the
    order come in any order among themselves, with either.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    if partition:
        total = F.sum(size).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumn("running", total).where(F.col("running") <= most)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # grows with the order inside and across ranges
    kept = written(ranged.select("*", F.spark_partition_id().alias("__range"), place.alias("__place")), "ranges", by="__range")
    sums = {r["__range"]: r["s"] for r in kept.groupBy("__range").agg(F.sum(size).alias("s")).collect()}  # one row a range
    before, near = {}, 0
    for r in sorted(sums):
        if near > most:
            break
        before[r], near = near, near + sums[r]
    if not before:
        return kept.withColumn("running", size).drop("__range", "__place").where(F.lit(False))
    base = F.create_map(*[F.lit(x) for r in before.items() for x in r])[F.col("__range")].cast("long")
    total = base + F.sum(size).over(W.partitionBy("__range").orderBy("__place").rowsBetween(W.unboundedPreceding, 0))
    return kept.where(F.col("__range").isin(list(before))).withColumn("running", total).where(F.col("running") <= most).drop("__range", "__place")


def fill_metadata(rows: DataFrame, manifest: DataFrame, root: str = "data/raw/") -> DataFrame:
    """rows (name, source, document_id, source_file, token_count, text) with nulls filled.

    Candidate paths are the given one, then name and underscored name in the folder of the
    source; the first in the manifest (path, document_id) decides, else its hash.
    """
    kind = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    folder = F.when(F.contains(kind, F.lit("wiki")), "wiki").when(F.contains(kind, F.lit("pdf")), "pdf_to_txt")
    name = F.trim(F.coalesce("name", F.lit("")))
    path = lambda n: F.when((F.length(n) > 0) & folder.isNotNull(), F.concat(F.lit(root), folder, F.lit("/"), n, F.lit(".txt")))
    given = F.nullif(F.col("source_file"), F.lit(""))
    tries = F.array_distinct(F.filter(F.array(given, path(name), path(F.replace(name, F.lit(" "), F.lit("_")))), lambda p: p.isNotNull()))
    out = rows.withColumns({"__tries": tries, "__id": F.lit(None).cast("string"), "__path": F.lit(None).cast("string")})
    known = manifest.select(F.col("path").alias("__known"), F.col("document_id").alias("__known_id"))
    for k in range(3):  # a candidate in the manifest decides, else its hash where no id is given, else the next one
        out = out.withColumn("__try", F.when(F.col("__path").isNull(), F.get("__tries", F.lit(k)))).join(known, F.col("__try") == F.col("__known"), "left")
        hashed = F.when(F.col("document_id").isNull() & F.startswith("__try", F.lit(root)), F.substring(F.sha2(F.substring_index("__try", root, -1), 256), 1, 16))
        found = F.coalesce("__known_id", hashed)
        out = out.withColumns({"__path": F.coalesce("__path", F.when(found.isNotNull(), F.col("__try"))), "__id": F.coalesce("__id", found)}).drop("__try", "__known", "__known_id")
    filled = {"document_id": F.coalesce("document_id", "__id"), "source_file": F.coalesce(given, "__path"), "token_count": F.coalesce(F.col("token_count").cast("long"), text.token_estimate(F.col("text")))}
    return out.withColumns(filled).drop("__tries", "__id", "__path")
