"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words, so a match can't begin inside one. The windows of all benchmark items
that have the same length share one set of tables: for each block of two words the shift by
which the search may advance without missing a window; for blocks that end a window a bucket
of windows, divided by their first word; a direct comparison confirms. Windows of ten words
make one set; items of one to nine words make at most nine more.

Scale: documents stream through a map-only pass, without a shuffle. The benchmark is a stated
query set; it is measured first and broadcast in blocks of about BLOCK_BYTES, one pass a block,
each pass handing its hits on to the next, TOGETHER of them in one task.

Cases: null and wordless texts have no words and no hits; null or wordless items have no
windows; an item without an id hits words but can't be listed; repeated items and ids count
once; repeated documents are judged row by row; empty tables give no rows or no hits; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

WINDOW = 10
#: Benchmark text broadcast at a time; its tables take some 25 times that in a worker.
BLOCK_BYTES = 4 << 20
#: Passes, and so Python workers, that run in one task before rows are written.
TOGETHER = 2
#: Multiplier of block hashes.
_BLOCK = 1000003

_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.translate(_WORD_BYTES).split() if text else []


class _Search:
    """The tables for windows of m words, as flat arrays of word numbers (0 is no word).

    shift has a byte for each block hash: how far the search may go on; blocks that share a hash
    share the lesser shift. Windows are sorted by the hash of their last block; bucket says
    where each hash begins.
    """

    def __init__(self, m: int, windows: dict[tuple[int, ...], list[int]]):
        self.m, self.block = m, min(2, m)
        self.longest = m - self.block + 1
        size = 1 << max(12, (4 * len(windows)).bit_length())  # neighbouring windows share their blocks
        self.mask = size - 1
        table = np.array(list(windows), np.int64).reshape(len(windows), m)
        shift = np.full(size, self.longest, np.uint8)
        for end in range(self.block - 1, m):  # later ends give lesser shifts, and are set last
            shift[self._hashes(table, end)] = m - 1 - end
        last = self._hashes(table, m - 1)
        order = np.argsort(last, kind="stable")
        self.shift = bytearray(shift.tobytes())
        self.bucket = array("I", np.searchsorted(last[order], np.arange(size + 1)).astype(np.uint32).tobytes())
        self.words = array("I", table[order].astype(np.uint32).tobytes())
        owners = list(windows.values())
        self.owner_at = array("I", np.r_[0, np.cumsum([len(owners[k]) for k in order])].astype(np.uint32).tobytes())
        self.owners = array("I", [i for k in order for i in owners[k]])

    def _hashes(self, table: np.ndarray, end: int) -> np.ndarray:
        key = table[:, end] if self.block == 1 else table[:, end - 1] * _BLOCK + table[:, end]
        return key & self.mask

    def find(self, ids: array, spans: list[tuple[int, int]], items: set[int]) -> None:
        m, mask, single = self.m, self.mask, self.block == 1
        shift, bucket, words, i, n = self.shift, self.bucket, self.words, self.m - 1, len(ids)
        while i < n:
            key = (ids[i] if single else ids[i - 1] * _BLOCK + ids[i]) & mask
            step = shift[key]
            if step:
                i += step
                continue
            start = i - m + 1
            first = ids[start]
            for k in range(bucket[key], bucket[key + 1]):
                if words[k * m] == first and words[k * m : k * m + m] == ids[start : i + 1]:
                    spans.append((start, i + 1))
                    items.update(self.owners[self.owner_at[k] : self.owner_at[k + 1]])
                    break  # windows differ from each other
            i += 1


class Matcher:
    """All windows of a block of benchmark items, given as (id or None, text bytes)."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.names: list[str | None] = []
        self.vocab: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if not ids:
                continue
            self.names.append(name)
            m = min(window, len(ids))
            for window_ids in {tuple(ids[i : i + m]) for i in range(len(ids) - m + 1)}:
                by_length[m][window_ids].append(len(self.names) - 1)
        self.searches = [_Search(m, w) for m, w in sorted(by_length.items())]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, spans of words inside window occurrences, ids of their items."""
        words = words_of(text)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if words and self.searches:
            get = self.vocab.get
            ids = array("I", [get(w, 0) for w in words])
            for search in self.searches:
                search.find(ids, spans, found)
        return len(words), spans, [self.names[i] for i in found if self.names[i] is not None]


def _covered(spans: list[tuple[int, int]]) -> int:
    total = last = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def matchers(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast matchers, each of at most about block_bytes of benchmark text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.encode("text", "UTF-8").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    out = []
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(((r.item_id, bytes(r.text)) for r in part.toLocalIterator()), key=lambda r: (r[0] or "", r[1]))
        out.append(spark.sparkContext.broadcast(Matcher(rows, window)))
    return out


def _passes(docs: DataFrame, passes: list, fields: list[tuple[str, T.DataType]], finish) -> DataFrame:
    """doc_id and what finish(n_words, spans, items) gives, after one pass for each matcher."""
    kept = [("text", T.StringType()), ("spans", T.ArrayType(T.IntegerType())), ("items", T.ArrayType(T.StringType()))]
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for k, matcher in enumerate(passes):
        last = k == len(passes) - 1
        schema = common.with_doc_id(docs, *(fields if last else kept))
        out = common.arrow_schema(schema)

        def run(batches, matcher=matcher, first=k == 0, last=last, out=out):
            for batch in common.slices(batches):
                spans = [[]] * batch.num_rows if first else batch.column(2).to_pylist()
                items = [[]] * batch.num_rows if first else batch.column(3).to_pylist()
                rows = []
                for text, old, ids in zip(common.text_bytes(batch.column(1)), spans, items, strict=True):
                    n, got, names = matcher.value.scan(text)
                    got = sorted({*zip(old[::2], old[1::2], strict=True), *got})
                    rows.append((n, got, sorted({*ids, *names})))
                if last:
                    columns = list(zip(*(finish(*r) for r in rows), strict=True))
                else:
                    columns = [batch.column(1), [[x for s in r[1] for x in s] for r in rows], [r[2] for r in rows]]
                yield common.typed(dict(zip(out.names, [batch.column(0), *columns], strict=True)), out)

        df = df.mapInArrow(run, schema)
        if not last and (k + 1) % TOGETHER == 0:
            df = common.written(df, "partly")
    return df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, spans (array of start, end in words, sorted) and items (ids, sorted)."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [("n_words", T.LongType()), ("spans", T.ArrayType(span)), ("items", T.ArrayType(T.StringType()))]
    return _passes(docs, matchers(benchmark, window, block_bytes), fields, lambda n, spans, items: (n, [{"start": a, "end": b} for a, b in spans], items))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    fields = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]

    def finish(n, spans, items):
        return n, _covered(spans), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(spans)

    return _passes(docs, matchers(benchmark, window, block_bytes), fields, finish)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs."""
    passes = matchers(benchmark, window, block_bytes)
    for k, matcher in enumerate(passes):
        docs = common.keep_rows(docs, lambda texts, m=matcher: [not m.value.scan(t)[1] for t in texts])
        if k + 1 < len(passes) and (k + 1) % TOGETHER == 0:
            docs = common.written(docs, "partly")
    return docs


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM bw)),
lengths AS (SELECT DISTINCT m FROM windows),
grams AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT doc_id, g.m, p, item_id FROM grams g JOIN windows USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS q FROM (SELECT DISTINCT doc_id, m, p FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
