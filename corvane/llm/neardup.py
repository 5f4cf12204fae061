"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits share
at least six of them, so a pair's tally of shared positional bytes must reach six; pairs that
reach it are verified by their bits. Posting lists of single bytes would hold a 256th of all
fingerprints each, and tallies over them grow with the square of the corpus. So postings are lists of
four positional bytes at once, two of the four two-byte blocks: six postings a fingerprint, and a pair
that may reach six meets in one at least, since its two other bytes lie in two blocks at most. Where two
fingerprints meet their tally may be anything from four; those below six are filtered before bits are looked at.

Scale: fingerprints are made in a map-only pass; equal ones collapse with map-side combining
(copies, however many, are one node); postings carry two longs. Chance meetings need 32 equal bits.
A posting of more than LARGE fingerprints is not compared; its members, known as they stream by, are posted
anew by six positional bytes (28 postings each), in which linked ones still meet. Members of such a posting differ in
two bytes only, so it holds at most 65,536 fingerprints, a bound that doesn't grow with the data.
Small postings give each verified pair once; larger ones give a spanning forest, which loses no
link between components. Components come from alternating large and small stars, each round
written to the shared folder. Hot fingerprints meet their component in a join that AQE may split.

Cases: a null or wordless text has fingerprint zero, linked like any other; fewer than three
words are one shingle; rows without an id get the component of their fingerprint (null if no
row there has an id); repeated rows stay repeated; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

SHINGLE, SEED, MAX_BITS = 3, 42, 2
LEAST = 8 - MAX_BITS


class Postings:
    """A family of sets of positional bytes; each set keys one posting of a fingerprint."""

    def __init__(self, sets: list[tuple[int, ...]]):
        self.sets = sets
        self.masks = [sum(0xFF << (8 * b) for b in s) for s in sets]
        #: By the set of equal bytes, the first posting in which such a pair meets (or none: the number of sets).
        self.first = np.array([next((k for k, s in enumerate(sets) if all(e >> b & 1 for b in s)), len(sets)) for e in range(256)])

    def of(self, distinct: DataFrame) -> DataFrame:
        """(c, k, fp): posting, the bytes that key it, and fingerprint, in order within partitions."""
        postings = F.array(*[F.struct(F.lit(c).cast("int").alias("c"), F.col("fp").bitwiseAND(F.lit(int(np.uint64(m).view(np.int64)))).alias("k")) for c, m in enumerate(self.masks)])
        rows = distinct.select(F.explode(postings).alias("p"), "fp").select("p.c", "p.k", "fp")
        return rows.repartition("c", "k").sortWithinPartitions("c", "k", "fp")


#: Two of four blocks of two bytes; and, for members of large postings, six bytes.
FOUR = Postings([(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)])
SIX = Postings(list(combinations(range(8), LEAST)))
#: Members of a posting by four bytes beyond which it is not compared.
LARGE = 1024
#: Postings by six bytes of up to so many members are compared pairwise.
_PAIRWISE = 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles, as an unsigned 64-bit number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(at[: -shingle].tolist(), (at[shingle:] - 1).tolist(), strict=True)]
    return _majority(np.fromiter(hashes, np.uint64, len(hashes)))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def work(texts):
        return [np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)]

    return common.map_texts(docs, lambda texts: [pa.array(x) for x in work(texts)], [("fp", T.LongType())])


def _pairs(family: Postings, posting: np.ndarray, fp: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs within runs of equal posting, each pair only in the first posting where it meets."""
    left, right = [], []
    run = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(1, int(sizes.max(initial=1))):
        a = np.flatnonzero(run[step:] == run[:-step])
        if not len(a):
            break
        b = a + step
        differ = fp[a] ^ fp[b]
        shared = differ.view(np.uint8).reshape(-1, 8) == 0
        enough = np.flatnonzero(shared.sum(axis=1) >= LEAST)  # the tally
        a, b, differ = a[enough], b[enough], differ[enough]
        first = family.first[np.packbits(shared[enough], axis=1, bitorder="little")[:, 0]]
        ok = (first == posting[a]) & (np.bitwise_count(differ) <= MAX_BITS) & (differ != 0)
        left.append(fp[a[ok]])
        right.append(fp[b[ok]])
    return np.concatenate(left or [fp[:0]]), np.concatenate(right or [fp[:0]])


def _forest(posting: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member of one large posting to the least of its component there."""
    low, high = sorted(set(range(8)) - set(SIX.sets[posting]))
    rest = ((fp >> np.uint64(8 * low)) & np.uint64(255)) | (((fp >> np.uint64(8 * high)) & np.uint64(255)) << np.uint64(8))
    rest = rest.astype(np.int64)
    label = np.full(1 << 16, 1 << 16, np.int64)
    label[rest] = rest
    masks = [0] + [sum(1 << b for b in c) for n in range(1, MAX_BITS + 1) for c in combinations(range(16), n)]
    while True:
        before = label[rest]
        best = before.copy()
        for m in masks:
            np.minimum(best, label[rest ^ m], out=best)
        label[rest] = best
        label[rest] = label[label[rest]]
        if np.array_equal(label[rest], before):
            break
    owner = np.zeros(1 << 16, np.uint64)
    owner[rest] = fp
    root = owner[label[rest]]
    far = root != fp
    return fp[far], root[far]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]


def _runs(c: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal posting start, and their sizes."""
    start = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
    return start, np.diff(np.r_[start, len(c)])


def _found(u: np.ndarray, v: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
    """Links (u, v), and members of large postings with null for v."""
    none = np.r_[np.zeros(len(v), bool), np.ones(len(large), bool)]
    columns = [pa.array(np.r_[u, large].view(np.int64)), pa.array(np.r_[v, large].view(np.int64), mask=none)]
    return pa.RecordBatch.from_arrays(columns, names=["u", "v"])


def _links_of_four(large: int):
    """Links (u, v) from batches of (posting, key, fp) in order; of a large posting its members, v being null.
    No more than a batch and `large` rows are held."""

    def run(batches):
        held, hot = None, None  # rows of the last run so far; key of the run if it is known to be large
        for batch in batches:
            if not batch.num_rows:
                continue
            c, k, fp = _columns(batch) if held is None else [np.concatenate(x) for x in zip(held, _columns(batch), strict=True)]
            start, sizes = _runs(c, k)
            many = sizes > large
            if hot is not None and hot == (c[0], k[0]):
                many[0] = True
            held, last = None, start[-1]
            if many[-1]:
                hot, last = (c[-1], k[-1]), len(c)
            else:
                hot, held = None, [x[last:] for x in (c, k, fp)]
            told = np.repeat(many, sizes)
            keep = ~told & np.repeat(sizes > 1, sizes) & (np.arange(len(c)) < last)
            whole = ~many & (sizes > 1) & (start < last)
            yield _found(*_pairs(FOUR, c[keep], fp[keep], sizes[whole]), fp[told])
        if held is not None:
            c, k, fp = held
            yield _found(*_pairs(FOUR, c, fp, np.array([len(c)])), fp[:0])

    return run


def _links_of_six(batches):
    """Links (u, v) from batches of (posting, key, fp) in order."""
    held: list[np.ndarray] | None = None

    def out(c, k, fp):
        start, sizes = _runs(c, k)
        big = sizes > _PAIRWISE
        keep = np.repeat(~big, sizes) & np.repeat(sizes > 1, sizes)
        pairs = [_pairs(SIX, c[keep], fp[keep], sizes[~big & (sizes > 1)])]
        pairs += [_forest(int(c[s]), fp[s : s + n]) for s, n in zip(start[big], sizes[big], strict=True)]
        return _found(*(np.concatenate(x) for x in zip(*pairs, strict=True)), fp[:0])

    for batch in batches:
        held = _columns(batch) if held is None else [np.concatenate(x) for x in zip(held, _columns(batch), strict=True)]
        c, k, fp = held
        if not len(c):
            continue
        cut = int(np.flatnonzero((c == c[-1]) & (k == k[-1]))[0])
        if cut:
            yield out(c[:cut], k[:cut], fp[:cut])
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield out(*held)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) among distinct fingerprints fp that connect exactly those at MAX_BITS or less, by way of others or not."""
    found = common.written(FOUR.of(distinct).mapInArrow(_links_of_four(LARGE), "u long, v long"), "links")
    crowded = found.where("v is null").select(F.col("u").alias("fp")).distinct()
    if crowded.isEmpty():
        return found
    return found.where("v is not null").union(SIX.of(crowded).mapInArrow(_links_of_six, "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that edges (u, v) name; root is the least node of its component.

    Alternating large and small stars: each round links a node's larger, then its smaller
    neighbours to its least one, so chains shrink by a constant factor in every round.
    """
    e = common.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, e = e, common.written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        common.drop(last)


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root (of the component, as a fingerprint) and component_id of each row."""
    prints = common.written(fingerprints(docs), "fingerprints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    stars = components(links(distinct))
    linked = stars.join(distinct, stars.node == distinct.fp).select("fp", "root", "least")
    whole = linked.groupBy("root").agg(F.min("least").alias("joint"))
    named = common.written(linked.select("fp", "root").join(whole, "root"), "components")
    named = distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("joint", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a signed long) and component_id of each row: the smallest id that links reach."""
    return _classes(docs).drop("root")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: that with the component's smallest id.

    Of rows repeated under that id one stays; a component whose rows all lack an id keeps one.
    """
    found = common.written(_classes(docs), "classes")
    mine = F.col("doc_id") == F.col("component_id")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(mine).alias("own")).where("own > 0")
    ids = common.written(ids, "ids")
    # a shuffled hash of ids at every size: texts move once and aren't sorted
    once = docs.join(ids.where("n = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    several = found.join(ids.where("n > 1").select("doc_id"), "doc_id", "left_semi").where(mine).groupBy("doc_id").agg(F.min("fp").alias("fp"))
    nameless = found.where("component_id is null").groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"))
    chosen = common.written(several.select("doc_id", "fp").union(nameless.select("doc_id", "fp")), "chosen")
    if chosen.isEmpty():
        return once
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])
    out = common.arrow_schema(schema)

    def run(batches):
        for batch in common.slices(batches):
            texts = common.text_bytes(batch.column(batch.schema.get_field_index("text")))
            prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=out.names)

    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__of"))
    rows = docs.join(chosen.select("__id"), docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi").mapInArrow(run, schema)
    rows = rows.join(chosen, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__of")), "left_semi")
    return once.union(rows.dropDuplicates(["doc_id", "__fp"]).select(docs.columns))
