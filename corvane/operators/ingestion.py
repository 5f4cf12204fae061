"""Corpus ingestion: files to parents and children, scanned, embedded and upserted.

Embedding and scanning are services; here they are functions from a DataFrame with text to one
with a further column, with deterministic stubs for tests and offline use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import chunking, merging
from corvane.sources.store import Merged, Store


def stub_embedding(width: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Unit vectors of hashed words: equal texts get equal vectors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        def one(t):
            v = np.zeros(width)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h & 0x8000 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return texts.map(one)

    return lambda rows: rows.withColumn("embedding", embed("text"))


def stub_scan(phrases: tuple[str, ...] = ("ignore previous instructions", "disregard all prior")) -> Callable[[DataFrame], DataFrame]:
    """label and score by plain phrases."""
    pattern = "|".join(phrases)
    hit = F.rlike(F.lower(F.coalesce("text", F.lit(""))), F.lit(pattern))
    return lambda rows: rows.withColumns({"label": F.when(hit, "MALICIOUS").otherwise("BENIGN"), "score": F.when(hit, 1.0).otherwise(0.0)})


@dataclass
class Outcome:
    loaded: int
    pending: int
    blocked: bool


def ingest(store: Store, docs: DataFrame, embed: Callable[[DataFrame], DataFrame], scan: Callable[[DataFrame], DataFrame] | None = None, mark: str = "\n\n") -> Outcome:
    """Chunk docs (name, source, path, text), scan all children, embed new or changed ones, upsert children and parents together.

    One malicious or unscannable chunk blocks the whole ingestion, before anything is written.
    """
    children, parents = chunking.chunks(docs, mark=mark), chunking.parents(docs, mark=mark).drop("number")
    loaded = children.count()
    if scan is not None and loaded and not chunking.scan_gate(scan(children)).first()["passed"]:
        return Outcome(loaded, 0, True)
    new = chunking.pending(children, store.read("children")) if store.has("children") else children
    n = new.count()
    if n or not store.has("parents"):
        store.commit({"children": Merged(embed(new), ["chunk_id"], merging.overwrite), "parents": Merged(parents, ["parent_id"], merging.overwrite)})
    return Outcome(loaded, n, False)
