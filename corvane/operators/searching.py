"""Many questions in one job, over stored blocks of postings and of vectors.

Postings are stored in blocks of one term and one range of children, each with its greatest weight. What
the blocks of a question's terms can give together tells which ranges can't hold a result, so they are
not read (block-max pruning, Ding and Suel 2011); what is left gives exact scores. Vectors are
stored in blocks of one cell (operators.indexing) as matrices; a question meets the blocks of its
nearest cells, or all blocks. Every step is a join or grouping by term, cell or question: neither
questions nor index are held by one task or the driver, and no pair of question and row leaves a
task unless the row is among the question's best there.

Tables: questions (query, terms array, v array), blocks as written by term_blocks() and vector_blocks().
A question without terms, or without a vector, has no rows in that leg; null ids of parents take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import lexical
from corvane.operators import indexing, retrieval
from corvane.session import written

#: Children of a range, ranges that give a question's first bound, vectors of a block, questions that meet a block at a time.
RANGE, FIRST, ROWS, TILE = 128, 8, 1024, 256
#: Of many questions: children of a range and of a group, questions of a share at most, and at least where shares are made for more tasks.
WIDE, CHILDREN, SHARE, LEAST = 1024, 1 << 13, 1 << 16, 256
#: Postings of a row of packed blocks, about, and how their files are written.
PACK, FILES = 1 << 18, {"maxRecordsPerFile": "8"}
#: Terms whose weights are kept for all children of a group, and what share of the children have them at least (one in so many); children of one parent up to which bounds are by child.
COMMON, COMMON_SHARE, WIDEST = 256, 8, 4
#: Scores are rounded, so that the order in which parts are added doesn't rank equal ones; bounds allow for it.
DIGITS, SLACK = 9, 2e-9


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def term_blocks(children: DataFrame, stats: DataFrame, stem: bool = False, buckets: int = indexing.BUCKETS, per: int = RANGE) -> DataFrame:
    """(bucket, term, range, top, n, posted): the postings (chunk_id, parent_id, weight) of a term within a range of about `per` children.

    A weight is the part of BM25 that depends on the child; the term's part is known from the sum of n. Ranges
    are dealt by the hash of the child, so that a block is small whatever the term's frequency, and no task holds
    a term. A range's children meet in one group, where their terms are counted and its blocks made, so that texts are
    exchanged once and postings never. stats is indexing.sizes(children, stem), one row.
    """
    rows, weighed = _ranges(children, stats, stem, per)
    kinds = {f.name: f.dataType for f in rows.schema}
    posted = T.StructType().add("chunk_id", kinds["chunk_id"]).add("parent_id", kinds["parent_id"]).add("weight", T.DoubleType())
    schema = T.StructType().add("term", T.StringType()).add("range", T.LongType()).add("top", T.DoubleType()).add("n", T.LongType()).add("posted", T.ArrayType(posted))
    out = _arrow(schema)

    def blocks(rows: pa.Table) -> pa.Table:
        terms, starts, at, weight = weighed(rows)
        if not len(at):
            return out.empty_table()
        taken = [rows.column(c).combine_chunks().take(pa.array(at)) for c in ("chunk_id", "parent_id")]
        posted = pa.StructArray.from_arrays([*taken, pa.array(weight)], names=["chunk_id", "parent_id", "weight"])
        held = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), posted)
        dealt = pa.array(np.full(len(terms), rows.column("range")[0].as_py()))
        return pa.table([terms, dealt, pa.array(np.maximum.reduceat(weight, starts)), pa.array(np.diff(np.append(starts, len(at)))), held], names=out.names).cast(out)

    return rows.groupBy("range").applyInArrow(blocks, schema).select(indexing.bucket_of(F.col("term"), buckets).alias("bucket"), *schema.names)


def _ranges(children: DataFrame, stats: DataFrame, stem: bool, per: int):
    """Children's terms (indexing.child_terms) with their range, and the terms, starts, rows and weights of the postings of a range."""
    size = stats.first()
    ranges = max(1, -(-size["n"] // per))
    k, b, mean = lexical.BM25_K1, lexical.BM25_B, size["avg_len"] or 1.0

    def weighed(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        terms, starts, at, tf = indexing.counted(rows)
        return terms, starts, at, tf * (k + 1) / (tf + k * (1 - b + b * rows.column("size").to_numpy()[at] / mean))

    return indexing.child_terms(children, stem).withColumn("range", F.pmod(F.xxhash64("chunk_id"), F.lit(ranges))), weighed


def _packed(chunk: T.DataType, parent: T.DataType) -> T.StructType:
    return (
        T.StructType().add("range", T.LongType()).add("chunk_ids", T.ArrayType(chunk)).add("parent_ids", T.ArrayType(parent))
        .add("terms", T.ArrayType(T.StringType())).add("n", T.ArrayType(T.IntegerType())).add("at", T.BinaryType()).add("weights", T.BinaryType())
    )


def _pack(out: pa.Schema, pack: int, number: int, chunk: pa.Array, parent: pa.Array, terms: pa.Array, n: np.ndarray, at: np.ndarray, weight: np.ndarray) -> pa.Table:
    """Rows of a range, each of about `pack` postings, whatever the length of the texts."""
    ends = np.cumsum(n)
    piece = (ends - 1) // pack
    cuts = [*np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), len(n)]
    found = [out.empty_table()]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        of = slice(ends[a] - n[a], ends[b - 1])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (chunk, parent, terms.slice(a, b - a), pa.array(n[a:b], pa.int32()))]
        found.append(pa.table([pa.array([number]), *lists, pa.array([at[of].astype("<i4").tobytes()]), pa.array([weight[of].astype("<f8").tobytes()])], names=out.names).cast(out))
    return pa.concat_tables(found)


def range_blocks(children: DataFrame, stats: DataFrame, stem: bool = False, per: int = WIDE, pack: int = PACK) -> DataFrame:
    """(range, chunk_ids, parent_ids, terms, n, at, weights): the postings of term_blocks(), some rows a range.

    A term has n postings: places in chunk_ids, and weights. For searches that read all blocks: there is no row and no name for each
    posting. To be written with FILES, since a reader holds many rows of a file.
    """
    rows, weighed = _ranges(children, stats, stem, per)
    schema = _packed(rows.schema["chunk_id"].dataType, rows.schema["parent_id"].dataType)
    out = _arrow(schema)

    def blocks(rows: pa.Table) -> pa.Table:
        terms, starts, at, weight = weighed(rows)
        return _pack(out, pack, rows.column("range")[0].as_py(), *(rows.column(c).combine_chunks() for c in ("chunk_id", "parent_id")), terms, np.diff(np.append(starts, len(at))), at, weight)

    return rows.groupBy("range").applyInArrow(blocks, schema)


def packed(blocks: DataFrame) -> DataFrame:
    """Blocks of term_blocks() as those of range_blocks()."""
    posted = blocks.schema["posted"].dataType.elementType
    schema = _packed(posted["chunk_id"].dataType, posted["parent_id"].dataType)
    out = _arrow(schema)

    def pack(rows: pa.Table) -> pa.Table:
        posted = rows.column("posted").combine_chunks()
        chunk, parent, weight = (posted.flatten().field(c) for c in ("chunk_id", "parent_id", "weight"))
        n = pc.list_value_length(posted).to_numpy(zero_copy_only=False)
        return _pack(out, PACK, rows.column("range")[0].as_py(), chunk, parent, rows.column("term").combine_chunks(), n, np.arange(len(chunk)), weight.to_numpy())

    return blocks.select("range", "term", "posted").groupBy("range").applyInArrow(pack, schema)


def _asked(questions: DataFrame, blocks: DataFrame, stats: DataFrame, buckets: int) -> DataFrame:
    """(query, bucket, term, range, idf, most): a row for each block of each question's terms, with what it can give at most."""
    asked = questions.select("query", F.explode(F.array_distinct("terms")).alias("term")).withColumn("bucket", indexing.bucket_of(F.col("term"), buckets))
    met = blocks.select("bucket", "term", "range", "top", "n").join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = met.groupBy("bucket", "term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(stats.select(F.col("n").alias("docs")))).select("bucket", "term", idf.alias("idf"))  # one row
    return asked.join(known, ["bucket", "term"]).join(met, ["bucket", "term"]).select("query", "bucket", "term", "range", "idf", (F.col("idf") * F.col("top")).alias("most"))


def _scored(asked: DataFrame, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query, parent_id, score): the parents in the wanted ranges (query, range) by their best child."""
    met = asked.join(wanted, ["query", "range"], "left_semi").join(blocks.select("bucket", "term", "range", "posted"), ["bucket", "term", "range"])
    rows = met.select("query", "idf", F.explode("posted").alias("p")).where("p.parent_id is not null")
    scored = rows.groupBy("query", F.col("p.chunk_id").alias("chunk_id"), F.col("p.parent_id").alias("parent_id")).agg(F.round(F.sum(F.col("idf") * F.col("p.weight")), DIGITS).alias("score"))
    return scored.groupBy("query", "parent_id").agg(F.max("score").alias("score"))


def _ranked(best: DataFrame, order: list, k: int) -> DataFrame:
    # rows beyond k of each question are cut before they are exchanged, and while they are sorted
    return best.withColumn("rnk", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rnk") <= k)


def keyword_ranges(asked: DataFrame, blocks: DataFrame, k: int = retrieval.CANDIDATES, first: int = FIRST) -> DataFrame:
    """(query, range): the ranges that may hold one of a question's k best parents.

    The `first` ranges of the greatest bounds give k parents a score at least. A range whose blocks together
    stay below the k-th of these holds no child of a result; where fewer than k parents are found, all are read.
    """
    bound = written(asked.groupBy("query", "range").agg(F.sum("most").alias("most")), "bounds")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("most"), "range"))
    sure = _scored(asked, bound.withColumn("rank", rank).where(F.col("rank") <= first), blocks)
    least = _ranked(sure, [F.desc("score"), F.col("parent_id")], k).groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") >= k)
    return bound.join(least, "query", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") * (1 - SLACK) - SLACK)).select("query", "range")


def keyword_leg(questions: DataFrame, blocks: DataFrame, stats: DataFrame, k: int = retrieval.CANDIDATES, buckets: int = indexing.BUCKETS) -> DataFrame:
    """(query, parent_id, score, rnk): the k parents of each question by BM25 of their best child; all that match where fewer do."""
    asked = written(_asked(questions, blocks, stats, buckets), "asked")  # met three times
    return _ranked(_scored(asked, keyword_ranges(asked, blocks, k), blocks), [F.desc("score"), F.col("parent_id")], k)


def _kept(q: np.ndarray, p: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Which of the rows (question, parent, score) are the best of a question's k best parents; of parents that tie with the last, the first."""
    order = np.lexsort((p, -s, q))
    first = np.sort(np.unique(q[order] * (int(p.max(initial=0)) + 1) + p[order], return_index=True)[1])
    order = order[first]
    return order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]


@dataclass
class _Postings:
    """Postings of a group of children by term: child and weight of those from starts[t] to starts[t + 1]. Children are numbered in the
    order of their parents, whose numbers are in `parent` and names in `names`."""

    starts: np.ndarray
    child: np.ndarray
    weight: np.ndarray
    parent: np.ndarray
    names: pa.Array

    @staticmethod
    def of(held: pa.Table, terms: pa.Array, idf: np.ndarray) -> _Postings:
        """Of blocks of ranges, the postings of the terms, times their idf; children without a parent have none."""
        chunk, parent, said, n = (held.column(c).combine_chunks().flatten() for c in ("chunk_ids", "parent_ids", "terms", "n"))
        chunk, parent = chunk.dictionary_encode(), parent.dictionary_encode()
        order = pc.array_sort_indices(parent.dictionary).to_numpy()
        place = np.empty(len(order) + 1, np.int64)
        place[order], place[-1] = np.arange(len(order)), len(order)  # null is last
        chunks = len(chunk.dictionary) + 1
        pairs, child = np.unique(place[parent.indices.fill_null(len(order)).to_numpy()] * chunks + chunk.indices.fill_null(chunks - 1).to_numpy(), return_inverse=True)
        pairs = pairs[: np.searchsorted(pairs, len(order) * chunks)]
        code, n = pc.index_in(said, value_set=terms).fill_null(-1).to_numpy(), n.to_numpy()
        sizes, counts = (np.append(0, np.cumsum(pc.list_value_length(held.column(c)).to_numpy())) for c in ("chunk_ids", "n"))
        found = []
        for i in range(held.num_rows):  # what isn't asked for goes row by row
            of, times = code[counts[i] : counts[i + 1]], n[counts[i] : counts[i + 1]]
            at, weight = (np.frombuffer(held.column(c)[i].as_buffer(), kind) for c, kind in (("at", "<i4"), ("weights", "<f8")))
            at = child[at + sizes[i]].astype(np.int32)
            some = np.repeat(of >= 0, times) & (at < len(pairs))
            found.append((np.repeat(of, times)[some], at[some], weight[some]))
        term, at, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.argsort(term.astype(np.int64) * max(1, len(pairs)) + at, kind="stable")
        term = term[order]
        return _Postings(np.searchsorted(term, np.arange(len(terms) + 1)), at[order].astype(np.int64), weight[order] * idf[term], pairs // chunks, parent.dictionary.take(pc.array_sort_indices(parent.dictionary)))

    def best(self, codes: np.ndarray, ends: np.ndarray, least: np.ndarray, k: int):
        """(question, parent, score), in pieces: the k best parents of questions whose terms are codes[ends[i] : ends[i + 1]].

        Where `least` is known, which is not above the k-th score, only children that reach it are looked for: the frequent terms that
        can't reach it together are then added up last, for the children that the others bring near enough (MaxScore, Turtle and Flood 1995).
        """
        n, size = len(self.parent), np.diff(self.starts)
        views = [(self.child[a:b], self.weight[a:b]) for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]
        common = np.argsort(-size, kind="stable")[:COMMON]
        common = common[size[common] > n / COMMON_SHARE]
        top, held = np.zeros(len(size)), [None] * len(size)
        for t in common.tolist():
            held[t] = np.zeros(n)
            np.add.at(held[t], *views[t])  # repeated ids may be in one list twice
            top[t] = held[t].max()
        starts = np.flatnonzero(np.concatenate([[True], np.diff(self.parent) != 0]))
        widest = int(np.diff(np.append(starts, n)).max())
        # of each question the terms that come early and late, these by their greatest weights
        question = np.repeat(np.arange(len(least)), np.diff(ends))
        order = np.lexsort((top[codes], question))
        order = order[size[codes[order]] > 0]
        question, codes = question[order], codes[order]
        floors = np.where(np.isnan(least), -np.inf, least * (1 - SLACK) - SLACK)
        summed = np.cumsum(top[codes])
        before = np.append(0, summed)[np.searchsorted(question, question)]
        late = (top[codes] > 0) & (summed - before < floors[question])
        lefts = np.bincount(question[late], top[codes[late]], len(least))
        (early, firsts), (late, lasts) = ((codes[x].tolist(), np.searchsorted(question[x], np.arange(len(least) + 1)).tolist()) for x in (~late, late))
        score, tiny = np.zeros(n), np.nextafter(0, 1)
        some = min(len(score), max(n // 8, k * widest))
        found: list[tuple] = []
        for i, (floor, left) in enumerate(zip(floors.tolist(), lefts.tolist(), strict=True)):
            score.fill(0)
            for x in early[firsts[i] : firsts[i + 1]]:
                if held[x] is None:
                    np.add.at(score, *views[x])
                else:
                    score += held[x]
            if floor == -np.inf:
                # k parents at least have one of the best children, as many as k parents have at most; some children tell a first bound
                best = np.maximum.reduceat(score, starts) if widest > WIDEST else score[:some]
                take = min(len(best), k if widest > WIDEST else k * widest)
                floor = np.partition(best, len(best) - take)[len(best) - take] - SLACK
            at = (score >= max(floor - left, tiny)).nonzero()[0]
            value = score[at]
            for x in late[lasts[i] : lasts[i + 1]][::-1]:
                value += held[x].take(at)
                left -= top[x]
                near = value >= floor - left
                at, value = at[near], value[near]
            if len(at) > 4 * k * widest:
                near = value >= np.partition(value, len(at) - k * widest)[len(at) - k * widest] - SLACK
                at, value = at[near], value[near]
            found.append((at, value))
            if len(found) == TILE or i + 1 == len(least):
                q = np.repeat(np.arange(i + 1 - len(found), i + 1), [len(x) for x, _ in found])
                p, s = self.parent[np.concatenate([x for x, _ in found])], np.concatenate([x for _, x in found]).round(DIGITS)
                kept = _kept(q, p, s, k)
                yield q[kept], p[kept], s[kept]
                found = []


def keyword_leg_of_many(questions: DataFrame, blocks: DataFrame, stats: DataFrame, k: int = retrieval.CANDIDATES, children: int = CHILDREN, share: int = SHARE) -> DataFrame:
    """keyword_leg for a set of questions that grows with the documents: nothing is kept for each question and range.

    Ranges are dealt in groups of about `children`, questions in shares of `share` at most; a group meets a share at once, and only the k
    best parents of each question leave it. As many groups as the root of their number come first: the k-th score found there
    is what children of the others must reach. Blocks are those of range_blocks(); those of term_blocks() are packed first.
    """
    if "posted" in blocks.columns:
        blocks = written(packed(blocks), "packed", options=FILES)
    asked = questions.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    n = stats.first()["n"]
    df = F.col("df")
    counts = blocks.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), "n")))
    known = counts.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)).alias("idf"))
    told = written(asked.join(known, "term").groupBy("query").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idf")), "told")  # a question's terms
    count, tasks = told.count(), 2 * questions.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n // children), min(tasks, 8 * n // children))  # smaller ones rather than many shares, to each of which postings are sent
    first = int(np.ceil(groups**0.5))
    schema = T.StructType().add("query", questions.schema["query"].dataType).add("parent_id", blocks.schema["parent_ids"].dataType.elementType).add("score", T.DoubleType())
    out = _arrow(schema)

    def run(told: pa.Table, held: pa.Table) -> pa.Table:
        found = [out.empty_table()]
        if not told.num_rows or not held.num_rows:
            return found[0]
        terms, idf = (told.column(c).combine_chunks() for c in ("terms", "idf"))
        ends = np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False)))
        coded = terms.flatten().dictionary_encode()
        codes, of = coded.indices.to_numpy().astype(np.int64), np.zeros(len(coded.dictionary))
        of[codes] = idf.flatten().to_numpy()
        posted = _Postings.of(held, coded.dictionary, of)
        if len(posted.names):
            query, least = told.column("query").combine_chunks(), told.column("least").to_numpy()
            for q, p, s in posted.best(codes, ends, least.astype(float), k):
                found.append(pa.Table.from_arrays([query.take(pa.array(q)), posted.names.take(pa.array(p)), pa.array(s)], schema=out))
        return pa.concat_tables(found)

    def met(told: DataFrame, a: int, b: int) -> DataFrame:
        """(query, parent_id, score) of the groups from a to b; shares are smaller where groups are few, so that there are enough tasks."""
        shares = max(1, -(-count // share), min(-(-count // LEAST), -(-tasks // (b - a))))
        held = blocks.select("chunk_ids", "parent_ids", "terms", "n", "at", "weights", F.pmod("range", F.lit(groups)).cast("long").alias("group")).where(F.col("group").between(a, b - 1)).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        dealt = told.withColumn("share", F.pmod(F.xxhash64("query"), F.lit(shares)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b - 1).cast("long"))))
        sides = [side.repartition(2 * shares * (b - a), "group", "share").groupBy("group", "share") for side in (dealt, held)]
        return sides[0].cogroup(sides[1]).applyInArrow(run, schema)

    ranked = lambda found: _ranked(found.groupBy("query", "parent_id").agg(F.max("score").alias("score")), [F.desc("score"), F.col("parent_id")], k)
    sure = ranked(met(told.withColumn("least", F.lit(None).cast("double")), 0, first))
    if first == groups:
        return sure
    sure = written(sure, "sure")
    least = sure.where(F.col("rnk") == k).select("query", F.col("score").alias("least"))
    return ranked(sure.drop("rnk").unionByName(met(told.join(least, "query", "left"), first, groups)))


def blocks_read(questions: DataFrame, blocks: DataFrame, stats: DataFrame, k: int = retrieval.CANDIDATES, buckets: int = indexing.BUCKETS) -> DataFrame:
    """(query, blocks, read): for each question the blocks of its terms, and how many of them a search reads."""
    asked = written(_asked(questions, blocks, stats, buckets), "asked")
    kept = keyword_ranges(asked, blocks, k).withColumn("kept", F.lit(1))
    return asked.join(kept, ["query", "range"], "left").groupBy("query").agg(F.count("*").alias("blocks"), F.count("kept").alias("read"))


def vector_blocks(children: DataFrame, cells: indexing.Cells | None = None, rows: int = ROWS) -> DataFrame:
    """(cell, chunk_ids, parent_ids, vectors): children with a vector and a parent in blocks of one cell (0 without cells)."""
    kept = children.where("embedding is not null and parent_id is not null").select("chunk_id", "parent_id", F.col("embedding").cast("array<float>").alias("embedding"))
    placed = indexing.with_cells(kept, cells).where("cell is not null") if cells is not None else kept.withColumn("cell", F.lit(0))
    ordered = placed.repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell")
    kinds = {f.name: f.dataType for f in kept.schema}
    schema = T.StructType().add("cell", T.IntegerType()).add("chunk_ids", T.ArrayType(kinds["chunk_id"])).add("parent_ids", T.ArrayType(kinds["parent_id"])).add("vectors", T.ArrayType(kinds["embedding"]))
    out = _arrow(schema)

    def run(batches):
        for batch in batches:
            cell = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            a = 0
            while a < len(cell):
                b = min(int(np.searchsorted(cell, cell[a], "right")), a + rows)
                part = batch.slice(a, b - a)
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.concat_arrays([part.column(part.schema.get_field_index(c))])).cast(f.type) for c, f in zip(("chunk_id", "parent_id", "embedding"), list(out)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([cell[a]], pa.int32()), *lists], schema=out)
                a = b

    return ordered.mapInArrow(run, schema)


def vector_leg(questions: DataFrame, blocks: DataFrame, cells: indexing.Cells | None = None, k: int = retrieval.CANDIDATES, tile: int = TILE) -> DataFrame:
    """(query, parent_id, score, rnk): the k parents of each question by the cosine of their nearest child, in the question's nearest
    cells, or among all children where there are no cells.

    Groups of blocks meet shares of questions as matrices, `tile` questions at a time, and only the k best parents of each question
    leave a group.
    """
    kept = questions.where("v is not null").select("query", F.col("v").cast("array<double>").alias("v"))
    kind = kept.schema["query"].dataType

    def probes(batches):
        for batch in batches:
            near = [cells.nearest(v) if cells is not None and len(v) == cells.centres.shape[1] else [0] if cells is None else [] for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=["query", "v", "cells"])

    looked = kept.mapInArrow(probes, T.StructType().add("query", kind).add("v", T.ArrayType(T.DoubleType())).add("cells", T.ArrayType(T.IntegerType())))
    asked = looked.select("query", "v", F.explode("cells").alias("cell"), F.col("query").alias("deal"))
    held = blocks.select("cell", "parent_ids", "vectors", F.element_at("chunk_ids", 1).alias("deal"))
    parts = blocks.groupBy("cell").agg(F.ceil(F.sum(F.size("chunk_ids")) / indexing.BLOCK).alias("parts"))
    sides = indexing.dealt(asked, held, parts, questions.count())
    schema = T.StructType().add("query", kind).add("parent_id", blocks.schema["parent_ids"].dataType.elementType).add("score", T.DoubleType())
    out = _arrow(schema)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [out.empty_table()]
        if not asked.num_rows or not held.num_rows:
            return found[0]
        parents, vectors = (held.column(c).combine_chunks().flatten() for c in ("parent_ids", "vectors"))
        sides = [indexing.matrices(n, v) for n, v in ((asked.column("query").combine_chunks(), asked.column("v").combine_chunks()), (parents, vectors))]
        for width in sides[0].keys() & sides[1].keys():  # vectors of another width are no neighbours
            (query, a), (names, m) = (side[width] for side in sides)
            order = pc.array_sort_indices(names)
            coded, m = names.take(order).dictionary_encode(), m[order.to_numpy()]
            names, parent = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            starts, take = np.searchsorted(parent, np.arange(len(names))), min(k, len(names))
            length = np.linalg.norm(m, axis=1)
            for i in range(0, len(a), tile):
                some = a[i : i + tile]
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = some @ m.T / (np.linalg.norm(some, axis=1)[:, None] * length)
                near[~np.isfinite(near)] = -np.inf
                best = np.maximum.reduceat(near, starts, axis=1) if len(names) < len(parent) else near
                least = np.partition(best, len(names) - take, axis=1)[:, [len(names) - take]] - SLACK
                q, p = np.nonzero((best >= least) & (best > -np.inf))
                score = best[q, p].round(DIGITS)
                of = _kept(q, p, score, k)
                found.append(pa.Table.from_arrays([query.take(pa.array(q[of] + i)), names.take(pa.array(p[of])), pa.array(score[of])], schema=out))
        return pa.concat_tables(found)

    found = sides[0].cogroup(sides[1]).applyInArrow(run, schema)
    best = found.groupBy("query", "parent_id").agg(F.round(F.max("score"), DIGITS).alias("score"))
    return _ranked(best, [F.desc("score"), F.col("parent_id")], k)


def hybrid(questions: DataFrame, parents: DataFrame, postings: DataFrame, stats: DataFrame, vectors: DataFrame, cells: indexing.Cells | None = None, k: int = retrieval.TOP_K, candidates: int = retrieval.CANDIDATES) -> DataFrame:
    """(query, rank, parent_id, rrf_score, vector_rank, keyword_rank): the k best parents of every question by reciprocal rank fusion."""
    legs = [leg.select("query", "parent_id", *[(F.col("rnk") if n == name else F.lit(None).cast("int")).alias(n) for n in ("vector_rank", "keyword_rank")]) for name, leg in (("vector_rank", vector_leg(questions, vectors, cells, candidates)), ("keyword_rank", keyword_leg_of_many(questions, postings, stats, candidates)))]
    part = lambda c: F.coalesce(F.sum(F.lit(1.0) / (retrieval.RRF + F.col(c))), F.lit(0.0))
    fused = legs[0].unionByName(legs[1]).groupBy("query", "parent_id").agg((part("vector_rank") + part("keyword_rank")).alias("rrf_score"), F.max("vector_rank").alias("vector_rank"), F.max("keyword_rank").alias("keyword_rank"))
    known = fused.join(parents.select("parent_id"), "parent_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("rrf_score"), "parent_id"))
    return known.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "parent_id", "rrf_score", "vector_rank", "keyword_rank")
