"""Removal of repeated byte strings by per-shard suffix arrays.

Every byte inside a string of LENGTH bytes that also starts anywhere else goes. Strings are
brought together by content: each window of LENGTH bytes has an anchor, the least hash among its
GRAM-byte strings, so equal windows have equal anchors wherever they stand. Neighbouring windows
of one anchor make a segment. Anchors that occur once can't hold a repeated window; segments of
an anchor that are all alike are repeated as a whole. Only the rest, the ends of what documents
share, needs suffix arrays: segments are dealt by anchor to shards, a shard's segments are
sorted by Larsson-Sadakane refinement (7 bytes first, then doubling, groups of one left alone),
Kasai's common prefixes are taken for all segments in lockstep, and a window repeats if it shares
LENGTH bytes with a neighbour in order. An anchor with more than SHARD segments or MEMORY bytes fills several
shards; fingerprints of their windows (128 bits) are merged by key, in order, and each shard's are looked up in all
shards' by binary search. Segments are known by their anchor and 128 bits of hash.

Scale: the first pass is map-only; anchors (about one in 85 bytes) are counted with map-side
combining and joined back as pairs of longs; texts move once, with what is known of their anchors,
and again only where a document has an end to resolve. Texts are known by 128 bits of hash, and equal texts share
lists. Shards are bounded by SHARD and MEMORY, within one anchor too; segments are at most RUN windows long, so very long and periodic texts take no
more memory. Hot anchors and hot copies meet in joins that AQE may split.

Cases: a null text is empty; texts under LENGTH bytes lose nothing; repeated rows count as
copies; overlaps within one text count; null ids are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

LENGTH, GRAM = 200, 32
#: Windows of a segment, bytes hashed at a time, segments of one anchor in a shard, bytes of a shard.
RUN, CHUNK, SHARD, MEMORY = 4096, 1 << 20, 4096, 1 << 21
_SPAN = LENGTH - GRAM + 1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

_OTHER = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _mixed(a: np.ndarray, b: np.ndarray, mix: tuple = _MIX) -> np.ndarray:
    x = (a * mix[0]) ^ (b + mix[1])
    x ^= x >> np.uint64(29)
    x *= mix[1]
    x ^= x >> np.uint64(32)
    return x


def _anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of the window at each position of data (bytes)."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    step = 8
    while step < GRAM:
        x = _mixed(x[:-step], x[step:])
        step *= 2
    step = 1
    while 2 * step <= _SPAN:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = _SPAN - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _parts(texts: list[bytes | None]):
    """(text number, offset, bytes), in lists of about CHUNK bytes; long texts overlap."""
    held, size = [], 0
    for k, text in enumerate(texts):
        if text is None or len(text) < LENGTH:
            continue
        for at in range(0, len(text) - LENGTH + 1, CHUNK):
            part = text[at : at + CHUNK + LENGTH - 1]
            held.append((k, at, part))
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def segments(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Text number, first window, windows, anchor and content hash (two halves) of every segment, and whether
    windows of the segment may be equal. Such windows lie in a periodic stretch that holds the
    last window's first GRAM bytes and one more copy of them before it."""
    found = [[np.zeros(0, np.int64)] for _ in range(3)] + [[np.zeros(0, np.uint64)] for _ in range(3)] + [[np.zeros(0, bool)]]
    for parts in _parts(texts):
        joined = b"".join(p[2] for p in parts)
        anchor = _anchors(np.frombuffer(joined, np.uint8))
        sizes = np.array([len(p[2]) for p in parts])
        start = np.r_[0, sizes.cumsum()[:-1]]
        windows = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(parts)), windows)
        local = np.arange(len(owner)) - np.repeat(np.r_[0, windows.cumsum()[:-1]], windows)
        at = start[owner] + local
        value = anchor[at]
        new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | (local[1:] % RUN == 0)])
        count = np.diff(np.r_[new, len(owner)])
        first = at[new]
        digest = xxhash.xxh3_128_digest
        hashes, again = [], np.empty(len(new), bool)
        for k, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
            segment = joined[a : a + n + LENGTH - 1]
            hashes.append(digest(segment))
            again[k] = n > _SPAN or segment.find(segment[n - 1 : n - 1 + GRAM]) < n - 1
        high, low = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2).T
        number, base = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        for out, x in zip(found, (number[owner[new]], base[owner[new]] + local[new], count, value[new], high, low, again), strict=True):
            out.append(x)
    return tuple(map(np.concatenate, found))


def suffix_order(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of data, each suffix ending at ends[position] (Larsson-Sadakane).

    Suffixes that are equal to their ends keep the order of their positions.
    """
    n = len(data)
    rest = ends - np.arange(n)
    padded = np.r_[data, np.zeros(7, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(8)) | np.where(k < rest, padded[k : k + n], np.uint64(0))
    key = (key << np.uint64(8)) | np.minimum(rest, 7).astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 7
    while True:
        single = head & np.r_[head[1:], True]
        slots = np.flatnonzero(~single)
        if not len(slots):
            return order, rank
        at = order[slots]
        ended = depth >= rest[at]
        second = np.where(ended, at - n, rank[np.minimum(at + depth, n - 1)])  # ended suffixes come first, by position
        pair = rank[at] * (2 * n) + (second + n)
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[slots] = at
        head[slots] = np.r_[True, pair[1:] != pair[:-1]]
        rank[at] = np.maximum.accumulate(np.where(head[slots], slots, 0))
        depth *= 2


def common_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length, up to `most`, shared by each suffix of at least `most` bytes with the one before it in order.

    Kasai's bound (a suffix shares at most one byte less than the one that starts a byte earlier)
    is carried along every segment; all segments advance in lockstep, by up to 8 bytes a step.
    """
    n = len(data)
    word = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for step in (1, 2, 4):
        word = word[: len(word) - step] | (word[step:] << np.uint64(8 * step))
    lcp = np.zeros(n, np.int64)
    last = ends[starts] - most
    carried = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    for k in range(int((last - starts).max(initial=-1)) + 1):
        live = live[starts[live] + k <= last[live]]
        at = starts[live] + k
        r = rank[at]
        before = order[np.maximum(r - 1, 0)]
        limit = np.minimum(most, ends[before] - before)
        limit[r == 0] = 0
        h = np.minimum(np.maximum(carried[live] - 1, 0), limit)
        going = np.flatnonzero(h < limit)
        while len(going):
            g = h[going]
            x = word[at[going] + g] ^ word[before[going] + g]
            equal = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3  # trailing equal bytes; 8 if all are
            g = np.minimum(g + equal, limit[going])
            h[going] = g
            going = going[(equal == 8) & (g < limit[going])]
        lcp[at] = h
        carried[live] = h
    return lcp


def repeated_windows(texts: list[bytes]) -> list[np.ndarray]:
    """For each segment the starts whose window of LENGTH bytes also stands elsewhere in these segments."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, sizes.cumsum()[:-1]].astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.repeat(starts + sizes, sizes)
    order, rank = suffix_order(data, ends)
    lcp = common_prefixes(data, starts, ends, order, rank)
    along = lcp[order]
    twice = np.empty(len(data), bool)
    twice[order] = (along >= LENGTH) | (np.r_[along[1:], 0] >= LENGTH)
    return [np.flatnonzero(twice[a : a + n - LENGTH + 1]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _prints(data: np.ndarray, mix: tuple) -> np.ndarray:
    x = data.astype(np.uint64)
    out, step, at = None, 1, 0
    while True:  # LENGTH is a sum of powers of two; a hash of each is mixed in
        if LENGTH & step:
            part = x[at:]
            out = part if out is None else _mixed(out[: len(part)], part, mix)
            at += step
        if 2 * step > LENGTH:
            return out
        x = x[:-step] | (x[step:] << np.uint64(8 * step)) if step < 8 else _mixed(x[:-step], x[step:], mix)
        step *= 2


def window_prints(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two fingerprints, mixed differently, of the window of LENGTH bytes at each start of each text, as signed numbers."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    both = [_prints(data, mix).view(np.int64) for mix in (_MIX, _OTHER)]
    starts = np.r_[0, sizes.cumsum()[:-1]]
    return [tuple(x[a : a + n - LENGTH + 1] for x in both) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _ranges(starts: np.ndarray, length: int = LENGTH) -> list[int]:
    """first, end, first, end ... of the bytes that windows at sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length], axis=1).ravel().tolist()


def _finish(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and kept_sha256 after removal of ranges."""
    kept, at, spans, removed = hashlib.sha256(), 0, 0, 0
    end = -1
    for a, b in sorted(ranges):
        spans += a > end
        kept.update(text[at:a] if a > at else b"")
        removed += max(0, b - max(a, end, 0))
        end = max(end, b)
        at = max(at, b)
    kept.update(text[at:])
    return len(text), removed, spans, kept.hexdigest()


_LONG = T.LongType()
_INTS = T.ArrayType(T.IntegerType())


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(m, s, t, h, g, again): anchor, content hash and text hashes of every segment; again: windows of one segment may be equal."""

    def run(batches):
        for batch in common.slices(batches):
            text, _, _, m, s, t, again = segments(common.text_bytes(batch.column(2)))
            h, g = (batch.column(k).to_numpy()[text] for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(s.view(np.int64)), pa.array(t.view(np.int64)), pa.array(h), pa.array(g), pa.array(again)], names=["m", "s", "t", "h", "g", "again"])

    return docs.select("h", "g", "text").mapInArrow(run, "m long, s long, t long, h long, g long, again boolean")


def _known(docs: DataFrame) -> DataFrame:
    """For each row doc_id, h, g and either its final columns or text, sure ranges and open segments."""
    rows = common.written(_anchor_rows(docs.where(F.octet_length("text") >= LENGTH)), "anchors")
    stats = rows.groupBy("m").agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b"), F.min("t").alias("c"), F.max("t").alias("d"), F.max("again").alias("again"))
    shared = stats.where("n > 1 or again").select("m", (F.col("again") | (F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))).alias("open"))
    lists = rows.select("m", "h", "g").join(shared, "m").groupBy("h", "g").agg(F.collect_set(F.struct("m", "open")).alias("shared"))
    lists = lists.select("h", "g", F.transform("shared", lambda x: x["m"]).alias("m"), F.transform("shared", lambda x: x["open"]).alias("open"))
    joined = docs.join(lists, ["h", "g"], "left").select("doc_id", "h", "g", "text", "m", "open")
    segment = T.StructType([T.StructField(n, t) for n, t in (("m", _LONG), ("s", _LONG), ("t", _LONG), ("at", T.IntegerType()), ("size", T.IntegerType()))])
    fields = [("h", _LONG), ("g", _LONG), ("n_bytes", _LONG), ("n_removed", _LONG), ("n_spans", _LONG), ("kept_sha256", T.StringType()), ("text", T.BinaryType()), ("sure", _INTS), ("open", T.ArrayType(segment))]
    schema = common.with_doc_id(docs, *fields)
    out = common.arrow_schema(schema)

    def run(batches):
        for batch in common.slices(batches):
            texts = [t or b"" for t in common.text_bytes(batch.column(3))]
            ms, opens = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            some = [t if m else None for t, m in zip(texts, ms, strict=True)]
            number, first, count, m, s, t, _ = segments(some)
            edge = np.searchsorted(number, np.arange(len(texts) + 1))
            rows = []
            for k, text in enumerate(texts):
                if not ms[k]:
                    rows.append((*_finish(text, []), None, None, None))
                    continue
                here = slice(edge[k], edge[k + 1])
                status = dict(zip(ms[k], opens[k], strict=True))
                anchors = m[here].view(np.int64).tolist()
                found = list(zip(anchors, s[here].view(np.int64).tolist(), t[here].view(np.int64).tolist(), first[here].tolist(), count[here].tolist(), strict=True))
                sure = [(a, a + n + LENGTH - 1) for x, _, _, a, n in found if status.get(x) is False]
                left = [{"m": x, "s": y, "t": z, "at": a, "size": n + LENGTH - 1} for x, y, z, a, n in found if status.get(x)]
                if left:
                    rows.append((len(text), None, None, None, text, [v for r in sure for v in r], left))
                else:
                    rows.append((*_finish(text, sure), None, None, None))
            columns = [list(c) for c in zip(*rows, strict=True)]
            yield common.typed(dict(zip(out.names, [*batch.columns[:3], *columns], strict=True)), out)

    known = common.written(joined.mapInArrow(run, schema), "known")
    common.drop(rows)
    return known


def _different(segments: list[tuple[int, bytes] | None]) -> list[tuple]:
    """For each segment, given by anchor and bytes, starts and fingerprints of windows that no earlier one of its anchor has."""
    some = [k for k, x in enumerate(segments) if x]
    found: list[tuple] = [([], [], [])] * len(segments)
    if some:
        prints = window_prints([segments[k][1] for k in some])
        owner = np.repeat(np.arange(len(some)), [len(p) for p, _ in prints])
        start = np.concatenate([np.arange(len(p)) for p, _ in prints])
        anchor = np.array([segments[k][0] for k in some], np.int64)[owner]
        f, g = (np.concatenate(x) for x in zip(*prints, strict=True))
        order = np.lexsort((g, f, anchor))  # stable: the first of equals stays first
        new = np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in (f, g, anchor)], axis=0)]
        kept = np.sort(order[new])
        edge = np.searchsorted(owner[kept], np.arange(len(some) + 1))
        for j, k in enumerate(some):
            part = kept[edge[j] : edge[j + 1]]
            found[k] = start[part], f[part], g[part]
    return found


def _shard_rows(batches):
    """(m, s, t, ranges, starts, prints, others) of segments sorted by anchor and shard. The last three, for anchors
    in several shards: one of each different window, with its fingerprints."""
    held: list[tuple] = []

    def out(rows):
        starts = repeated_windows([r[3] for r in rows])
        columns: list[list] = [[] for _ in range(7)]
        told = _different([(m, text) if shards > 1 else None for m, _, _, text, _, shards in rows])
        for (m, s, t, text, copies, _), twice, (more, *prints) in zip(rows, starts, told, strict=True):
            again = np.arange(len(text) - LENGTH + 1) if copies > 1 else twice
            for c, x in zip(columns, (m, s, t, _ranges(again), more, *prints), strict=True):
                c.append(x)
        types = [*[pa.int64()] * 3, *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types, strict=True)], names=["m", "s", "t", "ranges", "starts", "prints", "others"])

    size, last = 0, None
    for batch in batches:
        for shard, m, s, t, text, copies, shards in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (m, shard) != last and size >= MEMORY:
                yield out(held)
                held, size = [], 0
            last = (m, shard)
            held.append((m, s, t, text, copies, shards))
            size += len(text)
    if held:
        yield out(held)


def _lookup(batches):
    """(m, s, t, at): windows whose fingerprints another window has, from batches (m, f, g, s, t, at) sorted by anchor and fingerprints."""
    held = None
    for batch in _with_end(batches):
        got = None if batch is None else [c.to_numpy() for c in batch.columns]
        held = got if held is None else held if got is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
        if held is None or not len(held[0]):
            continue
        m, f = held[:2]
        cut = len(m) if batch is None else int(np.flatnonzero((m == m[-1]) & (f == f[-1]))[0])
        m, f, g, *rest = (x[:cut] for x in held)
        held = [x[cut:] for x in held]
        if cut:
            twice = np.zeros(cut, bool)
            for a in np.unique(m):  # each anchor's sorted fingerprints are looked up among themselves
                here = slice(np.searchsorted(m, a, "left"), np.searchsorted(m, a, "right"))
                part, other = f[here], g[here]
                several = np.searchsorted(part, part, "right") - np.searchsorted(part, part, "left") > 1
                same = (part[1:] == part[:-1]) & (other[1:] == other[:-1])  # in a run of one f, equal g stand together
                twice[here] = several & (np.r_[same, False] | np.r_[False, same])
            yield pa.RecordBatch.from_arrays([pa.array(x[twice]) for x in (m, *rest)], names=["m", "s", "t", "at"])


def _with_end(batches):
    yield from batches
    yield None


def _resolved(open_segments: DataFrame) -> DataFrame:
    """(m, s, t, ranges): the repeated bytes of each open segment, as offsets in it."""
    unique = common.written(open_segments.groupBy("m", "s", "t").agg(F.first("seg").alias("seg"), F.count("*").alias("copies")), "segments")
    sizes = unique.groupBy("m").agg(F.greatest(F.ceil(F.count("*") / SHARD), F.ceil(F.sum(F.octet_length("seg")) / MEMORY)).cast("int").alias("shards"))
    dealt = unique.join(sizes.where("shards > 1"), "m", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.col("s"), F.col("shards").cast("long")).cast("int"))
    done = dealt.select("shard", "m", "s", "t", "seg", "copies", "shards").repartition("m", "shard").sortWithinPartitions("m", "shard", "s", "t").mapInArrow(_shard_rows, "m long, s long, t long, ranges array<int>, starts array<int>, prints array<long>, others array<long>")
    done = common.written(done, "sorted")
    local = done.where(F.size("ranges") > 0).select("m", "s", "t", "ranges")
    across = done.where(F.size("starts") > 0).select("m", "s", "t", F.explode(F.arrays_zip("prints", "others", "starts")).alias("x")).select("m", F.col("x.prints").alias("f"), F.col("x.others").alias("g"), "s", "t", F.col("x.starts").alias("at"))
    found = across.repartition("m", "f").sortWithinPartitions("m", "f", "g").mapInArrow(_lookup, "m long, s long, t long, at int")
    merged = found.groupBy("m", "s", "t").agg(F.array_sort(F.collect_set("at")).alias("at")).select("m", "s", "t", F.flatten(F.transform("at", lambda a: F.array(a, a + LENGTH))).alias("ranges"))
    return local.union(merged)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = _known(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")))
    final = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rest = known.where("text is not null")
    cut = rest.select("text", F.explode("open").alias("o")).select("o.m", "o.s", "o.t", F.substring("text", F.col("o.at") + 1, F.col("o.size")).alias("seg"))
    ranges = _resolved(cut)
    places = rest.select("h", "g", F.explode("open").alias("o")).select("h", "g", "o.m", "o.s", "o.t", "o.at")
    shifted = places.join(ranges, ["m", "s", "t"]).select("h", "g", F.transform("ranges", lambda x: x + F.col("at")).alias("ranges")).distinct()
    found = shifted.groupBy("h", "g").agg(F.flatten(F.collect_list("ranges")).alias("found"))
    schema = T.StructType([known.schema[n] for n in final])
    out = common.arrow_schema(schema)

    def run(batches):
        for batch in common.slices(batches):
            rows = []
            for raw, sure, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = [*(sure or []), *(more or [])]
                rows.append(_finish(raw, list(zip(both[::2], both[1::2], strict=True))))
            yield common.typed(dict(zip(out.names, [batch.column(0), *map(list, zip(*rows, strict=True))], strict=True)), out)

    finished = rest.join(found, ["h", "g"], "left").select("doc_id", "text", "sure", "found").mapInArrow(run, schema)
    return known.where("text is null").select(final).union(finished)
