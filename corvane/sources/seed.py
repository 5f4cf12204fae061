"""Golden data sets: cases and evidence from JSON lines, inserted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane import schemas
from corvane.operators import merging
from corvane.sources.store import Merged, Store


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of cases or evidence; unknown fields are ignored, missing ones null."""
    return spark.read.schema(schemas.SCHEMAS[table]).json(path)


def load(store: Store, dataset: DataFrame, cases: DataFrame, evidence: DataFrame) -> None:
    """Insert what isn't stored yet, in one commit; loading twice changes nothing."""
    changed = {}
    for name, rows in (("datasets", dataset), ("cases", cases), ("evidence", evidence)):
        rows = rows.dropDuplicates(schemas.KEYS[name])
        changed[name] = Merged(rows, schemas.KEYS[name], merging.insert_new)
    store.commit(changed)


def pdf_texts(spark: SparkSession, path: str, extract) -> DataFrame:
    """(path, text) of PDF files by extract(bytes) -> list of page texts; unreadable files give null, files of no bytes no row."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches):
        def one(content):
            try:
                return "\n".join(extract(bytes(content)))
            except Exception:  # a broken file must not end the job
                return None

        for batch in batches:
            yield batch.assign(text=batch["content"].map(one))[["path", "text"]]

    return rows.mapInPandas(run, "path string, text string")
