"""Names, directions and display of evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Measures shown besides those at a cut-off, and how to read them.
EFFICIENCY = ("unique_parent_ratio", "duplicate_ratio", "retrieved_items", "retrieved_tokens")
PUBLIC = ("mrr", *EFFICIENCY)
MINIMIZED = ("duplicate_ratio",)
TRADE_OFFS = ("retrieved_items", "retrieved_tokens")
AT_CUT = r"^(recall|precision|hit_rate|ndcg)_at_([1-9][0-9]*)$"
LABELS = {"recall": "Recall", "precision": "Precision", "hit_rate": "HitRate", "ndcg": "nDCG"}
NAMES = {"mrr": "MRR", "unique_parent_ratio": "Unique parent ratio", "duplicate_ratio": "Duplicate ratio", "retrieved_items": "Retrieved items", "retrieved_tokens": "Retrieved tokens"}
UNITS = {"retrieved_items": "count", "retrieved_tokens": "tokens"}
#: Settings and model names that may be shown.
SHOWN_SETTINGS = (
    "top_k", "k_values", "retrieval_top_k", "prompt_version", "corpus_version", "model", "generator_model", "embedding_model",
    "max_context_chars", "max_output_tokens", "rag_security", "relevance_threshold", "retrieval_evaluator_version",
    "corpus_manifest_sha256", "evaluator_version",
)
SHOWN_MODELS = ("model", "generator_model", "embedding_model", "prompt_guard_model", "retrieval_model", "evaluator_model")
TIE = 0.0005


def is_public(name: Column) -> Column:
    return name.isin(*PUBLIC) | F.rlike(name, F.lit(AT_CUT))


def judged(name: Column, details: Column, key: str = "qrels_count") -> Column:
    """Efficiency measures always count; others only where the case has judgements."""
    return name.isin(*EFFICIENCY) | (F.coalesce(F.get_json_object(details, f"$.{key}").try_cast("int"), F.lit(0)) > 0)


def label(name: Column) -> Column:
    kind, k = F.regexp_extract(name, AT_CUT, 1), F.regexp_extract(name, AT_CUT, 2)
    at = F.concat(_mapped(kind, LABELS), F.lit("@"), k)
    return F.when(F.rlike(name, F.lit(AT_CUT)), at).otherwise(F.coalesce(_mapped(name, NAMES), F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))))


def _mapped(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def direction(name: Column) -> Column:
    return F.when(name.isin(*MINIMIZED), "minimize").when(name.isin(*TRADE_OFFS), "tradeoff").otherwise("maximize")


def unit(name: Column) -> Column:
    return F.coalesce(_mapped(name, UNITS), F.lit("score"))


def normalized_delta(name: Column, delta: Column) -> Column:
    """Positive is better; null where more is neither."""
    return F.when(name.isin(*MINIMIZED), -delta).when(name.isin(*TRADE_OFFS), F.lit(None)).otherwise(delta)


def winner(delta: Column) -> Column:
    """Which of evaluations A (candidate) and B (baseline) a normalised delta favours."""
    return F.when(delta.isNull(), "Trade-off").when(F.abs(delta) < TIE, "Tie").when(delta > 0, "A wins").otherwise("B wins")


def top_k(config: Column, fallback: Column | None = None) -> Column:
    """The first given setting as a positive number, else null."""
    given = F.coalesce(*[F.nullif(F.nullif(F.get_json_object(config, f"$.{k}"), F.lit("")), F.lit("0")) for k in ("top_k", "retrieval_top_k")], *([] if fallback is None else [fallback.cast("string")]))
    k = given.try_cast("int")
    return F.when(k > 0, k)


def at_cut(concept: Column, k: Column) -> Column:
    """The concept's measure at a run's cut-off (5 where unknown); other measures keep their name."""
    return F.when(concept.isin(*LABELS), F.concat(concept, F.lit("_at_"), F.coalesce(k, F.lit(5)).cast("string"))).otherwise(concept)


def _fixed(x: Column, digits: int, before: str = "", after: str = "", grouped: bool = False) -> Column:
    """Fixed-point text, halves rounded up."""
    return F.format_string(f"{before}%{',' if grouped else ''}.{digits}f{after}", x)


def shown(value: Column, kind: str = "score") -> Column:
    """Display text of a value in its unit."""
    x = value.try_cast("double")
    text = {
        "percent": _fixed(x * 100, 1, after="%%"),
        "milliseconds": F.when(x >= 1000, _fixed(x / 1000, 2, after=" s")).otherwise(_fixed(x, 0, after=" ms")),
        "currency": _fixed(x, 4, "$"), "count": _fixed(x, 0, grouped=True), "tokens": _fixed(x, 0, grouped=True),
    }.get(kind, F.when(F.abs(x) < 10, _fixed(x, 3)).otherwise(_fixed(x, 1, grouped=True)))
    return F.when(x.isNull(), "N/A").otherwise(text)


def shown_delta(value: Column, kind: str = "score") -> Column:
    x = value.try_cast("double")
    sign = F.when(x > 0, "+").otherwise("")
    text = {
        "percent": _fixed(x * 100, 1, after=" pp"), "milliseconds": _fixed(x, 0, after=" ms"),
        "currency": F.when(x < 0, _fixed(F.abs(x), 4, "-$")).otherwise(_fixed(x, 4, "$")),
        "count": _fixed(x, 0, grouped=True), "tokens": _fixed(x, 0, grouped=True),
    }.get(kind, _fixed(x, 3))
    return F.when(x.isNull(), "No baseline").otherwise(F.concat(sign, text))


def score_class(value: Column) -> Column:
    """good from .8, fair from .5, else poor; unknown for null."""
    return F.when(value.isNull(), "unknown").when(value >= 0.8, "good").when(value >= 0.5, "fair").otherwise("poor")
