"""The training-data pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns the rows
that go on, with the columns of documents; the last returns the pieces of packed sequences.
Between stages the rows are written as Parquet to the shared folder and read again, and what a
stage wrote on its way is deleted once its rows are written.

Cases, as each stage's operator defines them: a null text is judged as an empty one and keeps its
null until it is packed as its end id alone; null ids are ids like any other, save that of a near-duplicate
group without any id one row stays; repeated rows are near duplicates, of which one stays; very long
texts and runs of white space are taken whole; an empty table gives no rows; extra columns are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import common, decontam, neardup, packing, quality, secrets
from corvane.session import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets and linked parts of credentials in them are replaced by their kind."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of token ids, as op6 returns them."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack_sequences),
]

#: Trained and tokenizing stages have no SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    with common.scope(spark) as settle:
        for name, stage in STAGES[:-1]:
            docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
