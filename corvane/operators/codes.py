"""Product-quantised codes of vectors: a short code a row in place of its vector, and exact ranking of the best.

A vector, brought to unit length, is its cell's centre and a residual; the residual is cut into parts, and
each part is the number of the nearest of at most 256 centres, one byte. A question's product with a row is its product with the
cell's centre plus one entry of its distance table for each part. The best rows by that sum, as many as sampled questions needed,
are ranked anew by their vectors. Only codes are scanned; of the vectors, the candidates' alone are met.

Scale: centres come from a bounded sample (by hashed key), every row gets a code in one map-only pass. Questions go in tiles, as in
operators.searching, each to the blocks of its cells; a task keeps the wanted number of candidates for each question. One question
reads vectors through a filter on keys, which reaches the scan; many questions join their candidates to the vectors.

Cases: rows without a vector, with another width or a null, infinite or missing number in it have no code and are never found; a vector
of zeros has one and similarity null, last in order; a question like that has no neighbours; equal rows have equal
codes, and ties go by key; an empty table learns a single empty centre and codes nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from corvane.functions import vector
from corvane.operators import indexing

PARTS, VALUES, ROWS, TILE, GROUP = 16, 256, 4096, 64, 1 << 15
#: Share of the exact neighbours that the candidates of sampled questions hold.
TARGET = 0.98


@dataclass
class Codes:
    """Cells, part centres (parts, values, width of a part), rows of the sample, and how many of them had to be looked at."""

    cells: indexing.Cells
    centres: np.ndarray
    sampled: int
    needed: int

    @property
    def width(self) -> int:
        return self.cells.centres.shape[1]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts, width of a part), filled up with zeros."""
        n, size = self.centres.shape[0], self.centres.shape[2]
        return np.pad(x, ((0, 0), (0, n * size - x.shape[1]))).reshape(len(x), n, size)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code (rows, parts) of vectors of unit length."""
        cell = (x @ self.cells.centres.T).argmax(axis=1)
        cut = self.parts(x - self.cells.centres[cell])
        code = np.empty(cut.shape[:2], np.uint8)
        for p, centres in enumerate(self.centres):
            code[:, p] = ((centres**2).sum(axis=1) - 2 * cut[:, p] @ centres.T).argmin(axis=1)
        return cell, code

    def tables(self, questions: np.ndarray) -> np.ndarray:
        """(questions, parts, values): the product of each part of a question with each centre."""
        return np.einsum("qps,pvs->qpv", self.parts(questions), self.centres)

    def scores(self, questions: np.ndarray, tables: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """(questions, rows): the product with each row of one cell as its code has it."""
        out = np.repeat((questions @ self.cells.centres[cell])[:, None], len(code), axis=1)
        for p in range(code.shape[1]):
            out += tables[:, p, :][:, code[:, p]]
        return out


def _centres(x: np.ndarray, values: int, rounds: int) -> np.ndarray:
    out = x[np.unique(np.linspace(0, len(x) - 1, min(values, len(x))).astype(int))].copy()
    for _ in range(rounds):
        of = ((out**2).sum(axis=1) - 2 * x @ out.T).argmin(axis=1)
        n = np.bincount(of, minlength=len(out))
        sums = np.stack([np.bincount(of, column, minlength=len(out)) for column in x.T], axis=1)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def sound(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have the width and finite numbers, and those, brought to unit length."""
    rows = vectors.to_pylist()
    told = [v is not None and len(v) == width and None not in v for v in rows]
    x = np.array([v for v, ok in zip(rows, told, strict=True) if ok], np.float64).reshape(-1, width)
    finite = np.isfinite(x).all(axis=1)
    kept = np.array(told, bool)
    kept[kept] = finite
    return kept, indexing._unit(x[finite])


def learn_codes(rows: DataFrame, cells: indexing.Cells, key: str = "chunk_id", parts: int = PARTS, sample: int = indexing.SAMPLE, k: int = 10, target: float = TARGET, rounds: int = 12) -> Codes:
    """Codes from the `sample` rows of the least hashed keys. The number of candidates is the least with which sampled questions find
    the target share of their k exact neighbours in the sample; it grows with the table (`candidates_for`)."""
    chosen = rows.where("embedding is not null").orderBy(F.xxhash64(key), key).limit(sample).select(F.col("embedding").cast("array<double>").alias("v")).toArrow()  # `sample` rows at most
    width = cells.centres.shape[1]
    _, x = sound(chosen.column("v").combine_chunks(), width)
    parts = min(parts, width)
    codes = Codes(cells, np.zeros((parts, 1, -(-width // parts))), len(x), k)
    if not len(x):
        return codes
    cell = (x @ cells.centres.T).argmax(axis=1)
    cut = codes.parts(x - cells.centres[cell])
    learnt = [_centres(cut[:, p], VALUES, rounds) for p in range(parts)]
    codes.centres = np.stack(learnt)
    cell, code = codes.encode(x)
    asked = x[: indexing.TRIED]
    near = asked @ cells.centres.T[:, cell]
    tables = codes.tables(asked)
    for p in range(parts):
        near += tables[:, p, :][:, code[:, p]]
    exact = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    wanted = np.sort(np.take_along_axis(place, exact, axis=1).ravel())
    codes.needed = int(wanted[min(len(wanted) - 1, int(np.ceil(target * len(wanted))) - 1)]) + 1
    return codes


def candidates_for(codes: Codes, rows: int, k: int = 10) -> int:
    """Candidates of a question in a table of so many rows: the sample's share of them beyond the sample's size, twice k at least."""
    return max(2 * k, int(np.ceil(codes.needed * max(1.0, rows / max(1, codes.sampled)))))


def code_blocks(rows: DataFrame, codes: Codes, key: str = "chunk_id", size: int = ROWS) -> DataFrame:
    """(cell, keys, codes): every row with a sound vector, in blocks of one cell, codes one after another."""
    kind = rows.schema[key].dataType
    coded = T.StructType().add("key", kind).add("cell", T.IntegerType()).add("code", T.BinaryType())

    def encode(batches):
        for batch in batches:
            told, x = sound(batch.column(1), codes.width)
            cell, code = codes.encode(x) if len(x) else (np.zeros(0, int), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(told)), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=coded.names)

    placed = rows.where("embedding is not null").select(F.col(key).alias("key"), "embedding").mapInArrow(encode, coded)
    placed = placed.repartitionByRange("cell", F.xxhash64("key")).sortWithinPartitions("cell")
    schema = T.StructType().add("cell", T.IntegerType()).add("keys", T.ArrayType(kind)).add("codes", T.BinaryType())

    def gather(batches):
        for batch in batches:
            cell, code = batch.column(1).to_numpy(), batch.column(2)
            a = 0
            while a < len(cell):
                b = min(int(np.searchsorted(cell, cell[a], "right")), a + size)
                keys = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([cell[a]], pa.int32()), keys, pa.array([b"".join(code.slice(a, b - a).to_pylist())], pa.binary())], names=schema.names)
                a = b

    return placed.mapInArrow(gather, schema)


def candidates(questions: DataFrame, blocks: DataFrame, codes: Codes, n: int, tile: int = TILE) -> DataFrame:
    """(query, key): the n rows of each question (query, v) that are best by code, in the question's nearest cells.

    Blocks of all cells are dealt in groups of about GROUP, so that n rows of a question leave a group, not each of its cells.
    """
    kind, key = questions.schema["query"].dataType, blocks.schema["keys"].dataType.elementType
    looked = T.StructType().add("query", kind).add("v", T.ArrayType(T.DoubleType())).add("cells", T.ArrayType(T.IntegerType()))

    def probe(batches):
        for batch in batches:
            told, x = sound(batch.column(1), codes.width)
            near = [codes.cells.nearest(v) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(told)), pa.array(list(x), pa.list_(pa.float64())), pa.array(near, pa.list_(pa.int32()))], names=looked.names)

    met = questions.where("v is not null").select("query", F.col("v").cast("array<double>").alias("v")).mapInArrow(probe, looked)
    met = met.select(F.lit(0).alias("cell"), "query", "v", "cells", F.col("query").alias("deal"))
    held = blocks.select(F.lit(0).alias("cell"), F.col("cell").alias("of"), "keys", "codes", F.struct("cell", F.element_at("keys", 1)).alias("deal"))
    parts = blocks.agg(F.greatest(F.ceil(F.sum(F.size("keys")) / GROUP), F.lit(1)).alias("parts")).select(F.lit(0).alias("cell"), F.coalesce("parts", F.lit(1)).cast("long").alias("parts"))
    sides = indexing.dealt(met, held, parts, questions.count())
    schema = T.StructType().add("query", kind).add("key", key).add("score", T.DoubleType())
    out = to_arrow_schema(schema)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [out.empty_table()]
        if not held.num_rows or not asked.num_rows:
            return found[0]
        keys, of = held.column("keys").combine_chunks().flatten(), held.column("of").to_pylist()
        code = [np.frombuffer(c, np.uint8).reshape(-1, codes.centres.shape[0]) for c in held.column("codes").to_pylist()]
        query, cells = asked.column("query").combine_chunks(), [set(c) for c in asked.column("cells").to_pylist()]
        v = asked.column("v").combine_chunks().flatten().to_numpy().reshape(asked.num_rows, -1)
        for i in range(0, len(v), tile):
            q, some = v[i : i + tile], cells[i : i + tile]
            tables = codes.tables(q)
            near = np.full((len(q), len(keys)), -np.inf)
            at = 0
            for cell, c in zip(of, code, strict=True):
                rows = np.flatnonzero([cell in s for s in some])
                if len(rows):
                    near[rows, at : at + len(c)] = codes.scores(q[rows], tables[rows], cell, c)
                at += len(c)
            take = min(n, len(keys))
            # all that tie with the last stay, so that the cut between them is made once, by key
            q, r = np.nonzero((near >= np.partition(near, len(keys) - take, axis=1)[:, [len(keys) - take]]) & (near > -np.inf))
            found.append(pa.Table.from_arrays([query.take(pa.array(q + i)), keys.take(pa.array(r)), pa.array(near[q, r])], schema=out))
        return pa.concat_tables(found)

    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
    best = sides[0].cogroup(sides[1]).applyInArrow(run, schema)
    return best.withColumn("place", place).where(F.col("place") <= n).select("query", "key")


def neighbours(questions: DataFrame, blocks: DataFrame, rows: DataFrame, codes: Codes, n: int, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """(query, key, similarity): of each question's n candidates the k nearest by their vectors."""
    found = candidates(questions, blocks, codes, n).withColumnRenamed("key", key)
    vectors = rows.where("embedding is not null").select(key, "embedding")
    met = found.join(vectors, key).join(questions.select("query", F.col("v").cast("array<double>").alias("v")), "query")
    scored = met.select("query", key, (1 - vector.cosine_distance(F.col("embedding"), F.col("v"))).alias("similarity"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), key))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("query", key, "similarity")


def nearest(query: Sequence[float], blocks: DataFrame, rows: DataFrame, codes: Codes, n: int, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """(key, similarity): the k nearest rows of one question, whose candidates' keys reach the scan of the vectors as a filter."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(0, [float(x) for x in query])], "query int, v array<double>")
    cells = codes.cells.nearest(query) if len(query) == codes.width else []
    found = [r["key"] for r in candidates(asked, blocks.where(F.col("cell").isin(cells)), codes, n).collect()]  # n keys at most
    kept = rows.where(F.col(key).isin(found)) if found else rows.where("false")
    exact = kept.select(key, (1 - vector.cosine_distance(F.col("embedding"), [float(x) for x in query])).alias("similarity"))
    return exact.orderBy(F.desc_nulls_last("similarity"), key).limit(k)


def share_read(codes: Codes, rows: int, n: int, bytes_each: int = 4) -> float:
    """Bytes of all codes and of n vectors, over those of all vectors."""
    vector_bytes = codes.width * bytes_each
    return (rows * codes.centres.shape[0] + n * vector_bytes) / max(1, rows * vector_bytes)
