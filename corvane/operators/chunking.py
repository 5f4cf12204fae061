"""Documents to parents and overlapping children with stable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as X


def parents(docs: DataFrame, target: int = X.PARENT_CHARS, mark: str = "\n\n") -> DataFrame:
    """One row per parent of docs (name, source, path, text): parent_id, number, text, document_id, source_file, token_count.

    All in one row of one document, so no shuffle.
    """
    packed = X.pack_paragraphs(X.split_paragraphs(X.clean_text(F.col("text")), mark), target, mark)
    rows = docs.select("name", "source", "path", F.posexplode(packed).alias("number", "text"))
    return rows.select(
        X.parent_id(F.col("name"), F.col("source"), F.col("number")).alias("parent_id"), "name", "source", "number", "text",
        X.document_id(F.col("path")).alias("document_id"), F.col("path").alias("source_file"), X.token_estimate(F.col("text")).alias("token_count"),
    )


def chunks(docs: DataFrame, target: int = X.PARENT_CHARS, size: int = X.CHILD_CHARS, overlap: int = X.OVERLAP_CHARS, mark: str = "\n\n") -> DataFrame:
    """One row per child: chunk_id (numbered over the document), parent_id, text and provenance.

    The parents' windows are flattened inside the document's row, so numbering needs no window function.
    """
    packed = X.pack_paragraphs(X.split_paragraphs(X.clean_text(F.col("text")), mark), target, mark)
    nested = F.flatten(F.transform(packed, lambda p, i: F.transform(X.child_windows(p, size, overlap), lambda c: F.struct(i.alias("parent"), c.alias("text")))))
    rows = docs.select("name", "source", "path", F.posexplode(nested).alias("number", "c")).select("name", "source", "path", "number", "c.*")
    return rows.select(
        X.child_id(F.col("name"), F.col("source"), F.col("number")).alias("chunk_id"), X.parent_id(F.col("name"), F.col("source"), F.col("parent")).alias("parent_id"),
        "name", "source", "text", X.document_id(F.col("path")).alias("document_id"), F.col("path").alias("source_file"), X.token_estimate(F.col("text")).alias("token_count"),
    )


def pending(loaded: DataFrame, stored: DataFrame, key: str = "chunk_id", content: str | None = "text") -> DataFrame:
    """Loaded rows whose key is new, or whose content differs from the stored one."""
    if content is None:
        return loaded.join(stored.select(key), key, "left_anti")
    return loaded.join(stored.select(key, F.col(content).alias("__old")), [loaded[key] == stored[key], loaded[content].eqNullSafe(F.col("__old"))], "left_anti")


def scan_gate(scored: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: how many chunks were scanned, malicious or unscannable, and whether ingestion may go on."""
    bad = F.count_if(F.col("label") == "MALICIOUS")
    failed = F.count_if(F.col("label").isNull())
    return scored.agg(F.count(id_col).alias("scanned"), bad.alias("malicious"), failed.alias("unscannable"), ((bad == 0) & (failed == 0)).alias("passed"))


def worst_window(windows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, label, score): the malicious window with the highest score, else benign with zero."""
    bad = F.when(F.col("label") == "MALICIOUS", F.col("score"))
    return windows.groupBy(id_col).agg(F.when(F.max(bad).isNotNull(), "MALICIOUS").otherwise("BENIGN").alias("label"), F.coalesce(F.max(bad), F.lit(0.0)).alias("score"))


def token_windows(n_tokens, size: int = 510, stride: int = 255, least: int = 20):
    """Starts of the classifier's overlapping windows, those shorter than `least` left out."""
    starts = F.sequence(F.lit(0), F.greatest(n_tokens - 1, F.lit(0)), F.lit(size - stride))
    return F.filter(starts, lambda s: F.least(n_tokens - s, F.lit(size)) >= least)


def numbered(rows: DataFrame, partition: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Zero-based numbers within each partition."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1)
