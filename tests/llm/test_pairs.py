import hashlib
import random
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from helpers import corpus, docs, words

from corvane.llm import neardup, substrings


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """The least id of each row's component, by comparing all."""
    ids, values = [i for i, _ in prints], np.array([f for _, f in prints], np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 2).tolist():
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return [least.get(find(k)) for k in range(len(ids))]


def test_near_duplicates(spark):
    rows = [*corpus(), (300, "one"), (301, "ONE"), (204, "one"), (None, "one"), (None, "two words here now"), (None, "two words here now")]
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1)) for r in got) == sorted((i is None, i or 0, f) for i, f in prints)
    want = {(i, f, c) for (i, f), c in zip(prints, plain_components(prints), strict=True)}
    assert {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got} == want
    kept = neardup.drop_near_duplicates(docs(spark, rows)).collect()
    named = {c for _, _, c in want if c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(named)
    assert sum(r.doc_id is None for r in kept) == 1 and kept[0].__fields__ == docs(spark, rows).columns
    assert neardup.near_duplicates(docs(spark, rows).limit(0)).count() == 0 and neardup.drop_near_duplicates(docs(spark, rows).limit(0)).count() == 0


def links_of(spark, values):
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in set(values)], "fp long")
    return neardup.links(df)


@pytest.mark.parametrize(("pairwise", "large"), [(2, 3), (32, 40), (32, 10_000)])
def test_links_lose_nothing(spark, monkeypatch, pairwise, large):
    monkeypatch.setattr(neardup, "_PAIRWISE", pairwise)
    monkeypatch.setattr(neardup, "LARGE", large)
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    values = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, 64, 3)} | {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 3}
    chain = rng.getrandbits(64)
    for k in range(40):  # each two bits from the last
        chain ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        values.add(chain)
    values = sorted(values)
    roots = {r.node: r.root for r in neardup.components(links_of(spark, values)).collect()}
    mine = [roots.get(int(np.uint64(v).view(np.int64)), int(np.uint64(v).view(np.int64))) for v in values]
    want = plain_components(list(enumerate(values)))
    groups = lambda labels: sorted(tuple(k for k, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups(mine) == groups(want)


def test_postings_meet_and_tallies_filter():
    """Any two values at two bits or less meet in a posting; of those that meet, tallies below six are not verified."""
    for family in (neardup.FOUR, neardup.SIX):
        for a, b in combinations_with_replacement(range(8), 2):
            equal = 255 & ~(1 << a | 1 << b)
            assert family.first[equal] < len(family.sets)
    rng = np.random.default_rng(18)
    base = np.uint64(0x0123456789ABCDEF)
    fp = np.unique(np.r_[base, [base ^ np.uint64(int(x) << 32) for x in rng.integers(0, 1 << 32, 300)], [base ^ np.uint64(1 << b) for b in range(32, 64)]])
    place = neardup.FOUR.sets.index((0, 1, 2, 3))
    u, v = neardup._pairs(neardup.FOUR, np.full(len(fp), place), fp, np.array([len(fp)]))
    tally = lambda a, b: sum((int(a) ^ int(b)) >> (8 * k) & 255 == 0 for k in range(8))
    want = {(int(a), int(b)) for a, b in combinations(fp, 2) if (int(a) ^ int(b)).bit_count() <= 2 and neardup.FOUR.first[sum(1 << k for k in range(8) if (int(a) ^ int(b)) >> (8 * k) & 255 == 0)] == place}
    assert set(zip(u.tolist(), v.tolist(), strict=True)) == want and want
    assert any(4 <= tally(a, b) < 6 for a, b in combinations(fp[:50], 2))


@pytest.mark.parametrize("size", [1, 7, 50])
def test_large_postings_stream_by(size):
    """Whatever the batches, members of large postings are told and small ones compared."""
    keys = np.repeat(np.arange(6), [3, 40, 1, 12, 11, 10])
    fp = np.arange(len(keys)).astype(np.uint64) * np.uint64(1 << 40) + np.uint64(5)
    table = pa.table({"c": pa.array(np.zeros(len(keys), np.int32)), "k": pa.array(keys), "fp": pa.array(fp.view(np.int64))})
    out = pa.Table.from_batches(list(neardup._links_of_four(10)(table.to_batches(max_chunksize=size))))
    told = out.filter(pc.is_null(out["v"]))["u"].to_pylist()
    assert sorted(told) == sorted(fp[np.isin(keys, [1, 3, 4])].tolist())


def test_large_posting_gives_a_forest():
    """A posting of thousands gives fewer links than members, and the same components."""
    rng = np.random.default_rng(7)
    low = rng.choice(1 << 16, 6000, replace=False).astype(np.uint64)
    fp = np.sort(np.uint64(0xABCDEF0123450000) | low)
    place = neardup.SIX.sets.index((2, 3, 4, 5, 6, 7))
    u, v = neardup._forest(place, fp)
    assert len(u) < len(fp)
    left, right = set(u.tolist()), set(v.tolist())
    assert left <= set(fp.tolist()) and right <= set(fp.tolist()) and not left & right
    label = {int(x): int(x) for x in fp} | dict(zip(map(int, u), map(int, v), strict=True))
    some = rng.choice(len(fp), 60, replace=False)
    for a in some:
        near = fp[np.bitwise_count(fp ^ fp[a]) <= 2]
        assert len({label[int(x)] for x in near}) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 501), (501, 500), (7, 7)], "u long, v long").repartition(3)
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert neardup.components(edges.limit(0)).count() == 0


def plain_removal(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, t in raw:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_window_prints():
    """Equal windows, and they alone, have equal fingerprints."""
    rng = np.random.default_rng(19)
    texts = [bytes(rng.integers(97, 99, 700).astype(np.uint8)), b"ab" * 300, b"q" * 200]
    texts.append(texts[0][100:450] + b"!" + texts[0][:220])
    by = {}
    for t, prints in zip(texts, substrings.window_prints(texts), strict=True):
        assert [len(p) for p in prints] == [len(t) - 199] * 2
        for k, f in enumerate(zip(*(p.tolist() for p in prints), strict=True)):
            by.setdefault(t[k : k + 200], set()).add(f)
    assert all(len(f) == 1 for f in by.values())
    for half in range(2):
        assert len({min(f)[half] for f in by.values()}) == len(by)


def test_windows_that_share_half_a_fingerprint_stay_apart():
    """Windows of several shards are equal if both fingerprints are, across batches too."""
    import pyarrow as pa

    rows = sorted([(1, 5, 7, 10, 0, 3), (1, 5, 8, 11, 0, 4), (1, 5, 8, 12, 0, 5), (1, 6, 8, 13, 0, 6), (2, 5, 8, 14, 0, 7), (2, 9, 1, 15, 0, 8), (2, 9, 1, 16, 0, 9), (3, 9, 1, 17, 0, 9)])
    for size in (1, 3, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + size], strict=True)], names=list("mfgsta")) for a in range(0, len(rows), size)]
        found = [s for b in substrings._lookup(iter(batches)) for s in b.column(1).to_pylist()]
        assert found == [11, 12, 15, 16]


@pytest.mark.parametrize(("shard", "memory"), [(2, 1 << 21), (4096, 1 << 21), (4096, 2000)])
def test_substrings(spark, monkeypatch, shard, memory):
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "MEMORY", memory)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = noise(700)
    rows = corpus(n=20, long=1500) + [(400 + k, noise(40) + passage[rng.randint(0, 200) : rng.randint(450, 700)] + noise(40)) for k in range(25)]
    rows += [(500, noise(30) + passage[:300] + noise(9) + passage[100:400]), (501, passage[:199]), (502, "ab" * 400), (503, "q" * 250), (None, "null id " * 40), (504, rows[0][1]), (504, rows[0][1])]
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs(spark, rows)).collect()), key=str)
    assert got == plain_removal(rows)
    assert substrings.remove_repeats(docs(spark, rows).limit(0)).count() == 0


def test_long_texts_are_cut_into_parts(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 500)
    monkeypatch.setattr(substrings, "RUN", 60)
    text = bytes(np.random.default_rng(9).integers(97, 101, 3000).astype(np.uint8))
    number, first, count, m, *_ = substrings.segments([None, text, b"x" * 100, text[700:1100]])
    for k, size in ((1, 3000), (3, 400)):
        covered = np.concatenate([np.arange(a, a + n) for a, n in zip(first[number == k], count[number == k], strict=True)])
        assert np.array_equal(np.sort(covered), np.arange(size - 199))
    anchor = {k: {int(a) + j: int(x) for a, n, x in zip(first[number == k], count[number == k], m[number == k], strict=True) for j in range(n)} for k in (1, 3)}
    assert all(anchor[3][p] == anchor[1][p + 700] for p in range(201))


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(10)
    for letters, size in ((2, 60), (4, 300), (1, 90)):
        parts = [bytes(rng.integers(97, 97 + letters, int(rng.integers(30, size))).astype(np.uint8)) for _ in range(7)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        starts = np.r_[0, sizes.cumsum()[:-1]]
        ends = np.repeat(starts + sizes, sizes)
        order, rank = substrings.suffix_order(data, ends)
        suffix = [data[i : ends[i]].tobytes() for i in range(len(data))]
        assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffix[i], i)) and np.array_equal(rank[order], np.arange(len(data)))
        most = 20
        lcp = substrings.common_prefixes(data, starts, ends, order, rank, most)
        for i in range(len(data)):
            if len(suffix[i]) >= most and rank[i]:
                a, b = suffix[i], suffix[order[rank[i] - 1]]
                same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                assert lcp[i] == min(same, most)
