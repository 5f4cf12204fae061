"""Stored indexes for searches: term postings with statistics, and cells of vectors.

Both are plain tables, written by the caller (sources.store keeps them together) with the columns
`bucket` and `cell` as partitions, so that a query reads only the folders of its terms or cells. A
search without them (operators.retrieval) scans every row and is the exact path beside them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from corvane.functions import lexical
from corvane.operators import retrieval

BUCKETS = 64
#: Rows that cells are learnt from, and queries that decide how many cells are looked at.
SAMPLE, TRIED, CELLS, TARGET = 20_000, 200, 1024, 0.95
#: Rows of a block, queries that meet a block, of them those that do at once, and pairs that are summed at once.
BLOCK, SHARE, TILE, PAIRS = 8192, 4096, 256, 1 << 16
#: Children, about, whose terms are counted together where rows of one child come apart; frequent terms whose df is broadcast.
GROUP, COMMON = 1024, 1 << 16


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def child_terms(children: DataFrame, stem: bool = False) -> DataFrame:
    """(chunk_id, parent_id, size, said) of children: their number of terms, and these joined by blanks, which no term has."""
    terms = lexical.terms(F.col("text"))
    rows = children.select("chunk_id", "parent_id", (lexical.stemmed(terms) if stem else terms).alias("t"))
    return rows.select("chunk_id", "parent_id", F.size("t").alias("size"), F.array_join("t", " ").alias("said"))


def counted(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of child_terms by term: terms, where each begins in what follows, row of the child, its count. Rows of one child are one."""
    said = pc.split_pattern(rows.column("said").combine_chunks(), " ")
    known: dict[tuple, int] = {}
    child = np.array([known.setdefault(r, i) for i, r in enumerate(zip(*(rows.column(c).to_pylist() for c in ("chunk_id", "parent_id", "size")), strict=True))], np.int64)
    flat = said.flatten()
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # what a text without terms is split into
    coded = flat.filter(pa.array(some)).dictionary_encode()
    at = np.repeat(child, pc.list_value_length(said).to_numpy(zero_copy_only=False))[some]
    pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(child)) + at, return_counts=True)
    term, at = pair // max(1, len(child)), pair % max(1, len(child))
    return coded.dictionary, np.searchsorted(term, np.arange(len(coded.dictionary))), at, tf


def postings(children: DataFrame, stem: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, term, chunk_id, parent_id, tf, size, df): a row for each term of each child, with the number of
    children that have it and the child's number of terms.

    Terms are counted where the children are, without an exchange, into lists, one for each term and batch. The lists of
    the COMMON most frequent terms, which hold most postings, meet their df where they are; the others are exchanged by
    term. A frequent term's rows are never gathered in one group. Where a chunk_id comes twice, rows are first dealt by it.
    """
    rows = child_terms(children, stem)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType().add("term", T.StringType()).add("n", T.LongType())
    for name, kind in (("chunk_id", kinds["chunk_id"]), ("parent_id", kinds["parent_id"]), ("tf", T.IntegerType()), ("size", T.IntegerType())):
        schema = schema.add(name, T.ArrayType(kind))  # a list each: half the bytes of a list of structs
    out = to_arrow_schema(schema)

    def by_term(rows: pa.Table) -> pa.Table:
        terms, starts, at, tf = counted(rows)
        ends = pa.array(np.append(starts, len(at)), pa.int32())
        chunk, parent, size = (rows.column(c).combine_chunks().take(pa.array(at)) for c in ("chunk_id", "parent_id", "size"))
        held = [pa.ListArray.from_arrays(ends, x) for x in (chunk, parent, pa.array(tf, pa.int32()), size)]
        return pa.table([terms, pa.array(np.diff(ends.to_numpy()), pa.int64()), *held], names=out.names).cast(out)

    def run(batches):
        for batch in batches:
            yield from by_term(pa.Table.from_batches([batch])).to_batches()

    if children.groupBy("chunk_id").count().where("count > 1").isEmpty():
        found = rows.mapInArrow(run, schema)
    else:
        dealt = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-children.count() // GROUP))))
        found = rows.withColumn("group", dealt).groupBy("group").applyInArrow(by_term, schema)
    known = found.groupBy("term").agg(F.sum("n").alias("df"))
    common = F.broadcast(known.orderBy(F.desc("df"), "term").limit(COMMON))  # stated maximum
    lists = found.drop("n")
    met = lists.join(common, "term").unionByName(lists.join(common, "term", "left_anti").join(known, "term"))
    met = met.select("term", "df", F.inline(F.arrays_zip("chunk_id", "parent_id", "tf", "size")))
    return met.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "chunk_id", "parent_id", F.col("tf").cast("long").alias("tf"), "size", "df")


def sizes(children: DataFrame, stem: bool = False) -> DataFrame:
    """One row: number of children and their mean number of terms."""
    terms = lexical.terms(F.col("text"))
    return children.agg(F.count("*").alias("n"), F.avg(F.size(lexical.stemmed(terms) if stem else terms)).alias("avg_len"))


def keyword_scores(index: DataFrame, stats: DataFrame, wanted: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(chunk_id, parent_id, score) by BM25 of the children with any wanted term, from their postings alone."""
    some = index.sparkSession.range(1).select(*[bucket_of(F.lit(w), buckets) for w in wanted]).first() if wanted else []
    found = index.where(F.col("bucket").isin(sorted(set(some))) & F.col("term").isin(list(wanted))) if wanted else index.where("false")
    k, b = lexical.BM25_K1, lexical.BM25_B
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("size") / F.col("avg_len")))
    return found.crossJoin(F.broadcast(stats)).groupBy("chunk_id", "parent_id").agg(F.sum(part).alias("score"))  # stats: one row


def keyword_leg(index: DataFrame, stats: DataFrame, wanted: Sequence[str], candidates: int = retrieval.CANDIDATES) -> DataFrame:
    """(parent_id, rnk): as retrieval.keyword_leg by BM25, from postings."""
    best = keyword_scores(index, stats, wanted).where("parent_id is not null").groupBy("parent_id").agg(F.max("score").alias("s"))
    return retrieval.ranked(best, [F.desc_nulls_last("s"), F.col("parent_id")], candidates)


@dataclass
class Cells:
    """Centres of cells, of unit length, and the number of nearest cells that a search looks at."""

    centres: np.ndarray
    probes: int

    def nearest(self, query: Sequence[float]) -> list[int]:
        near = self.centres @ np.asarray(query, np.float64)
        return [int(c) for c in np.argsort(-near, kind="stable")[: self.probes]]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def learn_cells(rows: DataFrame, key: str = "chunk_id", sample: int = SAMPLE, cells: int = CELLS, k: int = 10, target: float = TARGET, rounds: int = 12) -> Cells:
    """Cells from the `sample` rows of the least hashed keys (a bounded sample, by spherical k-means), about as many as the
    root of the sample's size; probes are the fewest with which TRIED queries find the target share of their k exact
    neighbours among all rows. These queries come after the sample in that order, if there are as many rows: centres are nearer
    to the rows that they are learnt from than to others, and neighbours among few rows are in other cells than among all."""
    place = F.xxhash64(key)
    chosen = rows.where("embedding is not null").orderBy(place, key).limit(sample + TRIED).select(F.col("embedding").cast("array<double>").alias("v")).toArrow()  # stated maximum
    if not chosen.num_rows:
        return Cells(np.zeros((1, 1)), 1)
    x = _unit(np.stack(chosen.column("v").to_numpy()))
    x, queries = x[:sample], x[-TRIED:]
    centres = x[: max(1, min(cells, int(len(x) ** 0.5)))].copy()
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = x[of == c].mean(axis=0)
        centres = _unit(centres)
    asked = rows.sparkSession.createDataFrame(list(enumerate(queries.tolist())), "query int, v array<double>")
    exact = neighbours(rows, asked, k, key=key).where("similarity is not null")
    found = exact.join(with_cells(rows.select(key, "embedding"), Cells(centres, 1)), key).where("cell is not null").select("query", "cell").toArrow()  # k rows a sampled query
    place_of_cell = np.argsort(np.argsort(-(queries @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(place_of_cell[found.column("query").to_numpy(), found.column("cell").to_numpy()])
    return Cells(centres, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1 if len(needed) else len(centres))


def with_cells(rows: DataFrame, cells: Cells) -> DataFrame:
    """All rows with the number of their nearest cell; rows without a vector are in none."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    at = rows.schema.names.index("embedding")

    def run(batches):
        for batch in batches:
            vectors = batch.column(at).to_pylist()
            told = [v is not None and len(v) == cells.centres.shape[1] for v in vectors]
            of = np.full(len(vectors), -1)
            if any(told):
                of[told] = (np.array([v for v, ok in zip(vectors, told, strict=True) if ok], np.float64) @ cells.centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32(), mask=~np.array(told, bool))], names=schema.names)

    return rows.mapInArrow(run, schema)


def nearest(index: DataFrame, cells: Cells, query: Sequence[float], k: int = retrieval.TOP_K, where: Column | None = None) -> DataFrame:
    """As retrieval.nearest, over the rows of the query's nearest cells, exactly ranked."""
    return retrieval.nearest(index.where(F.col("cell").isin(cells.nearest(query))).drop("cell"), query, k, where)


def dealt(queries: DataFrame, rows: DataFrame, parts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by (cell, block, share), each pair of a query and a row of one cell in one group: parts (cell, parts), one row a
    cell, says in how many blocks a cell's rows are, n how many queries there are. The sides name what they are dealt by `deal`."""
    shares = max(1, -(-n // SHARE))
    rows = rows.join(F.broadcast(parts), "cell").withColumn("block", F.pmod(F.xxhash64("deal"), "parts")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))  # a row a cell
    asked = queries.join(F.broadcast(parts), "cell").withColumn("share", F.pmod(F.xxhash64("deal"), F.lit(shares)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return tuple(side.drop("parts", "deal").groupBy("cell", "block", "share") for side in (asked, rows))


def matrices(names: pa.Array, vectors: pa.Array) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """By width, names and vectors of lists without a null in them."""
    widths, whole = pc.list_value_length(vectors).to_numpy(zero_copy_only=False), np.ones(len(vectors), bool)
    if vectors.flatten().null_count:
        whole = np.array([None not in v for v in vectors.to_pylist()])
    told = {int(w): pa.array(np.flatnonzero((widths == w) & whole)) for w in np.unique(widths)}
    return {w: (names.take(i), vectors.take(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(i), w)) for w, i in told.items() if len(i)}


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, cells: Cells | None = None, key: str = "chunk_id") -> DataFrame:
    """(query, key, similarity): the k nearest rows of each query (query, v), a stated set; in its nearest cells only if cells are
    given (rows then have cell), else among all rows. A similarity that isn't known comes last.

    Blocks of rows meet shares of queries as matrices, and only the k best of each query leave a block. Rows of another width
    than a query's, or with a null in them, are no neighbours of it. A pair's similarity is the same whatever block it is
    in, so that copies rank by key, with cells and without.
    """
    rows = rows.where("embedding is not null").select(F.col(key).alias("key"), "embedding", F.col(key).alias("deal"), "cell" if cells is not None else F.lit(0).alias("cell")).where("cell is not null")
    queries = queries.where("v is not null").select("query", "v", F.col("query").alias("deal"))
    schema = T.StructType().add("query", queries.schema["query"].dataType).add(key, rows.schema["key"].dataType).add("similarity", T.DoubleType())
    if cells is None:
        looked = queries.withColumn("cell", F.lit(0))
    else:
        near = F.udf(lambda v: cells.nearest(v) if len(v) == cells.centres.shape[1] and None not in v else [], "array<int>")  # once a query
        looked = queries.withColumn("cell", F.explode(near("v")))
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    asked, held = dealt(looked, rows, parts, queries.count())
    out = to_arrow_schema(schema)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [out.empty_table()]
        sides = [matrices(t.column(n).combine_chunks(), t.column(v).combine_chunks()) for t, n, v in ((asked, "query", "v"), (held, "key", "embedding"))]
        for width in sides[0].keys() & sides[1].keys():
            (query, a), (names, m) = (s[width] for s in sides)
            order = pc.array_sort_indices(names)
            names, m = names.take(order), m[order.to_numpy()]
            length, take = np.linalg.norm(m, axis=1), min(k, len(names))
            for i in range(0, len(a), TILE):
                some = a[i : i + TILE]
                size = np.linalg.norm(some, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = some @ m.T / (size[:, None] * length)
                    rank = np.where(np.isnan(near), -np.inf, near)
                    # the product's last bits depend on the block: all that tie with the last up to rounding are summed anew, alike in all blocks
                    q, r = np.nonzero(rank >= np.partition(rank, len(names) - take, axis=1)[:, [len(names) - take]] - 1e-12)
                    best = np.concatenate([(some[q[j : j + PAIRS]] * m[r[j : j + PAIRS]]).sum(axis=1) for j in range(0, len(q), PAIRS)]) / (size[q] * length[r])
                best = np.where(np.isnan(near[q, r]), np.nan, best)
                order = np.lexsort((r, np.where(np.isnan(best), np.inf, -best), q))
                kept = order[np.arange(len(q)) - np.searchsorted(q, q[order]) < take]  # q is in order
                q, r, best = q[kept], r[kept], best[kept]
                found.append(pa.Table.from_arrays([query.take(pa.array(q + i)), names.take(pa.array(r)), pa.array(best, mask=np.isnan(best))], schema=out))
        return pa.concat_tables(found)

    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), key))
    return asked.cogroup(held).applyInArrow(run, schema).withColumn("place", place).where(F.col("place") <= k).drop("place")


def recall(exact: DataFrame, found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: number of queries, and the share of their exact neighbours that were found."""
    hit = exact.join(found.select("query", key, F.lit(1).alias("hit")), ["query", key], "left")
    return hit.agg(F.count_distinct("query").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
