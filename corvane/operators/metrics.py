"""Retrieval measures per case, set-oriented over all cases.

ranked: (case_id, rank, item_id, parent_id, token_count); qrels: (case_id, item_id, relevance).
Repeated items keep their first place and ranks close up before relevance is scored; ratios
and totals see the raw list. Everything is grouped by case, so hot cases only matter beyond
their own list's length.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUTS, THRESHOLD, DEFAULT_TOP_K = (3, 5, 10), 2, 5


def check_cuts(cuts: Iterable[int]) -> tuple[int, ...]:
    """The cut-offs, if all are positive whole numbers."""
    cuts = tuple(cuts)
    for k in cuts:
        if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
            raise ValueError("k must be a positive integer")
    return cuts


def cuts_for(config: dict) -> tuple[int, ...]:
    """A run's cut-offs: its k_values, else its top_k, else the default ones."""
    if config.get("k_values"):
        return check_cuts(config["k_values"])
    return check_cuts([config["top_k"]]) if config.get("top_k") else CUTS


def qrels(evidence: DataFrame) -> DataFrame:
    """Judgements per case: the highest relevance of each document, else parent, else chunk."""
    item = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("document_id", "parent_id", "chunk_id")])
    rows = evidence.select("case_id", item.alias("item_id"), "relevance").where("item_id is not null")
    return rows.groupBy("case_id", "item_id").agg(F.max("relevance").alias("relevance"))


def deduped(ranked: DataFrame) -> DataFrame:
    """First places only, ranks closed up."""
    first = ranked.groupBy("case_id", "item_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy("rank", "item_id")))


def relevance_scores(ranked: DataFrame, judged: DataFrame, cuts: Iterable[int] = CUTS, threshold: int = THRESHOLD, cases: DataFrame | None = None) -> DataFrame:
    """Per case: recall, precision, hit rate and nDCG at each cut-off, and mrr.

    Without relevant items recall is one and the others zero; without judgements nDCG is one.
    """
    cuts = check_cuts(cuts)
    cases = (cases if cases is not None else ranked.select("case_id").unionByName(judged.select("case_id"))).select("case_id").distinct()
    ideal_rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("relevance"), "item_id"))
    gain = lambda at: (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col(at) + 1.0)
    ideal = judged.withColumn("at", ideal_rank).groupBy("case_id").agg(
        F.count_if(F.col("relevance") >= threshold).alias("relevant"), *(F.sum(F.when(F.col("at") <= k, gain("at"))).alias(f"ideal_{k}") for k in cuts),
    )
    hits = deduped(ranked).join(judged, ["case_id", "item_id"]).groupBy("case_id").agg(
        F.min(F.when(F.col("relevance") >= threshold, F.col("rank"))).alias("first"),
        *(F.count_if((F.col("relevance") >= threshold) & (F.col("rank") <= k)).alias(f"hits_{k}") for k in cuts),
        *(F.sum(F.when(F.col("rank") <= k, gain("rank"))).alias(f"dcg_{k}") for k in cuts),
    )
    rows = cases.join(ideal, "case_id", "left").join(hits, "case_id", "left")
    found = {"mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0))}
    for k in cuts:
        n = F.coalesce(f"hits_{k}", F.lit(0))
        found[f"recall_at_{k}"] = F.when(F.coalesce("relevant", F.lit(0)) > 0, n / F.col("relevant")).otherwise(1.0)
        found[f"precision_at_{k}"] = n / F.lit(float(k))
        found[f"hit_rate_at_{k}"] = F.when(n > 0, 1.0).otherwise(0.0)
        found[f"ndcg_at_{k}"] = F.when(F.coalesce(f"ideal_{k}", F.lit(0.0)) > 0, F.coalesce(f"dcg_{k}", F.lit(0.0)) / F.col(f"ideal_{k}")).otherwise(1.0)
    return rows.select("case_id", *(c.alias(n) for n, c in found.items()))


def list_scores(ranked: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Per case, over the raw list: unique_parent_ratio, duplicate_ratio, retrieved_items, retrieved_tokens."""
    parent = F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), F.col("item_id"))
    rows = ranked.select("case_id", parent.alias("p"), F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).alias("t"))
    out = rows.groupBy("case_id").agg(F.count_distinct("p").alias("parents"), F.count("*").alias("items"), F.sum("t").alias("tokens"))
    if cases is not None:
        out = cases.select("case_id").distinct().join(out, "case_id", "left")
    ratio = F.coalesce(F.col("parents") / F.col("items"), F.lit(1.0))
    return out.select("case_id", ratio.alias("unique_parent_ratio"), (1 - ratio).alias("duplicate_ratio"), F.coalesce("items", F.lit(0)).cast("long").alias("retrieved_items"), F.coalesce("tokens", F.lit(0)).cast("long").alias("retrieved_tokens"))


def evaluate(ranked: DataFrame, judged: DataFrame, cuts: Iterable[int] = CUTS, threshold: int = THRESHOLD, cases: DataFrame | None = None) -> DataFrame:
    """All measures in long form: (case_id, metric_name, score), 5 + 4 per cut-off for each case."""
    cases = (cases if cases is not None else ranked.select("case_id").unionByName(judged.select("case_id"))).select("case_id").distinct()
    wide = relevance_scores(ranked, judged, cuts, threshold, cases).join(list_scores(ranked, cases), "case_id")
    names = [c for c in wide.columns if c != "case_id"]
    return wide.select("case_id", *(F.col(c).cast("double").alias(c) for c in names)).unpivot("case_id", names, "metric_name", "score")
