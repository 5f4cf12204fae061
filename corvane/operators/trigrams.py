"""Substring filters from stored trigrams, verified by the filter itself.

The index has blocks of keys for each trigram of each field, lower-cased as ilike does. Blocks are made where
the rows are, from SLICE_CHARS of text at a time, and each such run is in order of its trigrams: written with
small pages (PAGES) a reader skips those that hold none of a needle's, written in folders by bucket it reads
only theirs. Nothing is exchanged or sorted, and what a task holds doesn't grow with the table. A pattern's
literal runs of three or more characters give trigrams that every match must hold; where one of them has few
keys, the rows that have them all are met by key, and ilike decides on these alone. Where all are frequent, or
there is no such run (short needles, wildcards in between), every row is looked at, as without an index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Trigrams of a pattern that are looked up, spread over it; others are left to the verification.
LOOKED_UP = 6
#: Keys of a needle's rarest trigram up to which rows are met by key; they are broadcast.
MOST_KEYS = 65_536
#: Characters of text that a task cuts at a time, or one longer text.
SLICE_CHARS = 2 << 20
#: How an index is written, so that a trigram's blocks are found by pages.
PAGES = {"parquet.page.row.count.limit": "512"}


def bucket_of(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _parts(lengths: np.ndarray) -> Iterator[slice]:
    """Neighbouring texts of SLICE_CHARS in all, or one longer one."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        stop = int(np.searchsorted(ends, SLICE_CHARS + (ends[start - 1] if start else 0), "right"))
        yield slice(start, stop := max(stop, start + 1))
        start = stop


def blocks(texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The trigrams of some texts in order, where the block of each begins and the last ends, and places of texts in blocks, once each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    first = np.flatnonzero(text[:-2] == text[2:])
    number, known = pd.factorize(signs[first] << 42 | signs[first + 1] << 21 | signs[first + 2], sort=True)
    pairs = np.sort(number * len(texts) + text[first])
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    number, place = np.divmod(pairs, len(texts))
    written = np.stack([known >> 42, known >> 21 & 0x1FFFFF, known & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [written[i : i + 3] for i in range(0, len(written), 3)], np.searchsorted(number, np.arange(len(known) + 1)), place


def postings(rows: DataFrame, key: str, fields: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gram, field, keys), several rows for each gram and field. A null field has no grams; no rows are grouped."""
    fields = list(fields)
    texts = rows.select(F.col(key).alias("key"), *(F.coalesce(F.lower(F.col(f).cast("string")), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)))

    def run(batches):
        for batch in batches:
            for field, column in zip(fields, batch.columns[1:], strict=True):
                said = column.to_pylist()
                for part in _parts(np.fromiter(map(len, said), np.int64, len(said))):
                    grams, ends, place = blocks(said[part])
                    keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.column(0)[part].take(pa.array(place)))
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([field] * len(grams), pa.string()), keys], names=["gram", "field", "keys"])

    kind = T.StructType([T.StructField("gram", T.StringType()), T.StructField("field", T.StringType()), T.StructField("keys", T.ArrayType(rows.schema[key].dataType))])
    return texts.mapInArrow(run, kind).select(bucket_of(F.col("gram"), buckets).alias("bucket"), "gram", "field", "keys")


def literal_runs(pattern: str) -> list[str]:
    """What stands between the wildcards % and _ of a pattern; a backslash takes the next one as it is."""
    runs, held, i = [], "", 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            held, i = held + pattern[i + 1], i + 2
            continue
        if pattern[i] in "%_":
            runs.append(held)
            held = ""
        else:
            held += pattern[i]
        i += 1
    return [r for r in [*runs, held] if r]


def looked_up(rows: DataFrame, pattern: str, buckets: int = BUCKETS) -> list[tuple[int, str]]:
    """(bucket, gram) of the pattern's trigrams that are looked up; none where no run has three characters."""
    runs = F.transform(F.lit(literal_runs(pattern) or [""]), F.lower)  # as the index is
    said = rows.sparkSession.range(1).select(runs).first()[0]
    grams = list(dict.fromkeys(r[i : i + 3] for r in said for i in range(len(r) - 2)))
    step = max(1, -(-len(grams) // LOOKED_UP))
    told = rows.sparkSession.range(1).select(F.transform(F.lit(grams[::step] or [""]), lambda g: bucket_of(g, buckets))).first()[0]
    return list(zip(told, grams[::step], strict=False))


def _held(index: DataFrame, fields: Sequence[str], wanted: list[tuple[int, str]]) -> DataFrame:
    return index.where(F.col("bucket").isin(sorted({b for b, _ in wanted})) & F.col("gram").isin([g for _, g in wanted]) & F.col("field").isin(list(fields)))


def fewest(index: DataFrame, fields: Sequence[str], wanted: list[tuple[int, str]]) -> int:
    """How many keys the rarest of the wanted trigrams has, in all the fields."""
    found = {r["gram"]: r["n"] for r in _held(index, fields, wanted).groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()}  # LOOKED_UP rows at most
    return min(found.get(g, 0) for _, g in wanted)


def candidates(index: DataFrame, key: str, fields: Sequence[str], wanted: list[tuple[int, str]]) -> DataFrame:
    """(key): rows of which one of the fields holds all the wanted trigrams."""
    some = _held(index, fields, wanted).select("gram", "field", F.explode("keys").alias(key))
    every = reduce(lambda a, b: a & b, (F.bool_or(F.col("gram") == g) for _, g in wanted))
    return some.groupBy(key, "field").agg(every.alias("every")).where("every").select(key).distinct()


def containing(rows: DataFrame, index: DataFrame, key: str, fields: Sequence[str], wanted: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of which one of the fields contains the wanted text in either case; % and _ in it keep their meaning."""
    pattern = f"%{wanted}%"
    match = F.lit(False)
    for f in fields:
        match = match | F.coalesce(F.col(f).cast("string").ilike(pattern), F.lit(False))
    looked = looked_up(rows, wanted, buckets)
    if looked and fewest(index, fields, looked) <= MOST_KEYS:
        found = candidates(index, key, fields, looked).withColumnRenamed(key, "__key")
        rows = rows.join(F.broadcast(found), F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    return rows.where(match)
