"""Terms of texts, matching and ranking by terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English function words that queries and texts drop in stemmed mode.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "if",
    "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "she", "so", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "were", "what", "when", "where", "which", "who", "will", "with", "you",
)
BM25_K1, BM25_B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def _measure(stem: str) -> int:
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(kinds[i : i + 2] == "vc" for i in range(len(kinds)))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _short_end(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffix pairs of steps 2, 3 and suffixes of step 4 of the published stemming algorithm (fixed values).
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def porter_stem(w: str) -> str:
    """The stem of an English word (Porter 1980)."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "aeioulsz":
                w = cut[:-1]
            else:
                w = cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            w = stem if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))) else w
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """Stems of the words that are no function words."""
    known: dict[str, str | None] = {}

    def one(w):
        if w not in known:
            known[w] = None if w in STOP_WORDS else porter_stem(w)
        return known[w]

    return words.map(lambda ws: None if ws is None else [s for s in map(one, ws) if s])


def query_terms(text: str, stem: bool = False) -> list[str]:
    """The distinct terms of a query, sorted; in stemmed mode none may be left."""
    import re

    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    if stem:
        words = [porter_stem(w) for w in words if w not in STOP_WORDS]
    return sorted(set(words))


def matches_any(doc_terms: Column, wanted: list[str]) -> Column:
    """At least one wanted term; nothing matches an empty query."""
    return F.arrays_overlap(doc_terms, F.lit(wanted)) if wanted else F.lit(False)


def matches_all(doc_terms: Column, wanted: list[str]) -> Column:
    """All wanted terms; nothing matches an empty query."""
    return F.size(F.array_except(F.lit(wanted), doc_terms)) == 0 if wanted else F.lit(False)


def term_count(doc_terms: Column, wanted: list[str]) -> Column:
    """How many of the terms are wanted ones, repeats included."""
    return F.size(F.filter(doc_terms, lambda t: t.isin(wanted))).cast("long") if wanted else F.lit(0).cast("long")


def bm25(docs: DataFrame, key: str, doc_terms: str, wanted: list[str]) -> DataFrame:
    """(key, score) of the documents with any wanted term (Robertson and Zaragoza 2009).

    Statistics are one aggregate over all documents; one row is broadcast, never documents.
    """
    sized = docs.select(key, F.col(doc_terms).alias("t"), F.size(doc_terms).alias("len"))
    times = lambda word: F.size(F.filter("t", lambda t: t == F.lit(word)))
    tf = [times(w).alias(f"tf{i}") for i, w in enumerate(wanted)]
    counted = sized.select(key, "len", *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (BM25_K1 + 1) / (F.col(f"tf{i}") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len")))
    found = " or ".join(f"tf{i} > 0" for i in range(len(wanted))) or "false"
    return counted.where(found).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # one row
