import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, docs, lower, words

from corvane.llm import decontam, packing, quality, rules, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items, window=10):
    grams = {}
    for name, text in items:
        w = WORD.findall(lower(text or ""))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + m]), set()).add(name)
    out = {}
    for i, text in rows:
        w = WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for m in {len(g) for g in grams}:
            for p in range(len(w) - m + 1):
                if g := grams.get(tuple(w[p : p + m])):
                    hit.update(range(p, p + m))
                    found |= g
        ids = sorted(str(x) for x in found if x is not None)
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(spark, block_bytes):
    rows = corpus()
    by = dict(rows)
    items = [(1, " ".join(by[3].split()[2:25])), (2, by[100]), (3, "one"), (4, "ONE, two"), (5, None), (6, "..."), (7, by[100][:300]), (None, by[5]), (7, by[100][:300]), (8, " ".join(by[9].split()[-9:]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.judge(docs(spark, rows), bench, block_bytes=block_bytes).collect()}
    assert got == brute_contamination(rows, items)
    kept = {r.doc_id for r in decontam.drop_contaminated(docs(spark, rows), bench, block_bytes=block_bytes).collect()}
    assert kept == {i for i, r in got.items() if not r[4]}
    spans = {r.doc_id: sum(len(range(s.start, s.end)) > 0 for s in r.spans) for r in decontam.contamination(docs(spark, rows), bench, block_bytes=block_bytes).collect()}
    assert {i for i, n in spans.items() if n} == {i for i, r in got.items() if r[4]}


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.judge(docs(spark, corpus()).limit(0), none).count() == 0
    assert decontam.judge(docs(spark, corpus(n=3)), none).where("contaminated").count() == 0
    assert decontam.judge(docs(spark, [(None, "a b"), (1, "a b"), (1, "a b")]), none).count() == 3


def test_rules_counts(spark):
    rows = [*corpus(), (300, "l1\nl1\n \nl1 \nl1"), (301, " ".join(["a b c d e f g h"] * 3)), (302, "# $ | < x &")]
    got = {r.doc_id: r for r in rules.judge(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count, hit = Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                hit.update(range(k, k + 8))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and (not r.base_failed or not r.kept)
    assert rules.judge(docs(spark, rows).limit(0)).count() == 0


def test_rules_reject_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" * int(k) for k in rng.integers(3, 8, 60))) for i in range(150)] + [(900, " ".join("w%%%#" for _ in range(60))), (901, " ".join("abc" + "d" * 40 + str(k) for k in range(60)))]
    df = spark.createDataFrame([(i, t, "en", "one") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rules.judge(df).collect()}
    assert not kept[900] and not kept[901] and sum(kept[i] for i in range(150)) >= 149


def plain_estimate(x):
    """The estimate of rows x by the same starts, steps and factors, one row at a time in numpy; and the least determinant."""
    floor = np.diag(np.square(rules.FLOOR))
    rank = lambda v, share: np.sort(v, axis=0)[int(np.ceil(share * len(v))) - 1]
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    scatter = lambda y: np.cov(y.T, bias=True)
    middle = rank(x, 0.5)
    spread = 1.4826 * rank(abs(x - middle), 0.5)
    z = (x - middle) / np.sqrt(spread**2 + np.diag(floor))
    norm = (z**2).sum(axis=1)
    half = x[norm <= rank(norm, 0.5)]
    starts = [(middle, np.diag(spread**2)), (middle, scatter(np.tanh(z)) * np.outer(spread, spread)), (half.mean(axis=0), scatter(half))]
    found = []
    for m, c in starts:
        last, c = None, c + floor
        while True:
            d = distance(m, c)
            near = x[d <= rank(d, rules.COVERED)]
            m, c = near.mean(axis=0), scatter(near) + floor
            det = np.linalg.det(c)
            if last is not None and det >= last[0] * (1 - rules.FALL):
                break
            last = det, m, near
        found.append(last)
    det, m, near = min(found, key=lambda f: f[0])
    near = x[distance(m, scatter(near) * rules._consistency(0.75) + floor) <= rules.NEAR]
    return near.mean(axis=0), scatter(near) * rules._consistency(0.975) + floor, det


def grouped(rng):
    """Rows of groups with outliers, heavy tails, few rows and no spread."""
    groups = {("en", "a"): rng.normal(0, 0.1, (200, 4)), ("en", None): rng.standard_t(3, (90, 4)) * 0.2, ("fr", "a"): np.ones((60, 4)), ("fr", "b"): rng.normal(1, 0.3, (20, 4)), (None, "a"): rng.normal(2, 0.3, (7, 4))}
    groups["en", "a"][:40] = rng.normal(3, 0.01, (40, 4))
    groups["fr", "c"] = np.r_[np.zeros((70, 4)), rng.normal(0, 1, (12, 4))]
    return groups


def test_mcd_against_plain_version(spark):
    """Estimates equal a plain version's, and no random start finds a covered share of much lesser determinant."""
    rng = np.random.default_rng(20)
    groups = grouped(rng)
    rows = [(lang, source, *map(float, v)) for (lang, source), x in groups.items() for v in x]
    stats = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double").repartition(4)
    got = {(r.lang, r.source): r for r in rules.pooled_estimates(stats).collect()}
    assert got.keys() == groups.keys()
    for (lang, source), x in groups.items():
        pool = x if len(x) >= 50 else np.concatenate([y for (other, _), y in groups.items() if lang in (None, other)])
        mean, scatter, det = plain_estimate(pool)
        r = got[lang, source]
        inverse = np.linalg.inv(scatter)
        assert np.allclose([r[f"m{i}"] for i in range(4)], mean, atol=1e-7) and np.isclose(r.det, det, rtol=1e-6)
        assert np.allclose([r[f"p{i}{j}"] for i, j in rules._PAIRS], [inverse[i, j] for i, j in rules._PAIRS], rtol=1e-4, atol=1e-4)
    x, floor, least = groups["en", "a"], np.diag(np.square(rules.FLOOR)), np.inf
    for _ in range(200):
        y = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(20):
            m, c = y.mean(axis=0), np.cov(y.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            y = x[np.argsort(d)[:150]]
        least = min(least, np.linalg.det(np.cov(y.T, bias=True) + floor))
    assert got["en", "a"].det <= least * 1.02


def test_verdicts_are_those_of_the_distance(spark):
    """Distances of whole texts equal those from the plain estimate; a row on the cut stays."""
    rng = np.random.default_rng(21)
    rows = [(i, " ".join("w" * int(k) + "#" * int(rng.integers(0, 9) == 0) + str(j) for j, k in enumerate(rng.integers(2, 9, rng.integers(20, 90))))) for i in range(120)]
    df = spark.createDataFrame([(i, t, "en", "one") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    x = []
    for _, t in rows:
        n, chars, symbols, same, again, lines = rules.counts(t.encode())
        root = lambda part, whole: np.arcsin(np.sqrt(part / whole))
        x.append([np.log((chars + 250) / (n + 50)), root(symbols, chars + 50), root(same, lines + 5), root(again, n + 50)])
    x = np.array(x)
    mean, scatter, _ = plain_estimate(x)
    want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
    assert np.allclose([got[i].distance for i, _ in rows], want, rtol=1e-4) and all(got[i].kept == (got[i].distance <= rules.CUT) for i, _ in rows)
    some = got[5].distance
    assert rules.judge(df, cut=some).where(f"distance = {some!r}").first().kept


def test_chi_square_points():
    assert np.isclose(rules._point(0.75), 5.38527, atol=1e-4) and np.isclose(rules.NEAR, 11.14329, atol=1e-4) and np.isclose(rules.CUT, 23.5127, atol=1e-3)


def test_rules_judge_small_groups(spark):
    """Groups too small for an estimate are judged by their language, or by all rows."""
    rng = np.random.default_rng(6)
    text = lambda: " ".join("w" * int(k) for k in rng.integers(3, 8, 60))
    rows = [(i, text(), "es", f"s{i % 9}") for i in range(90)] + [(200 + i, text(), None, "s1") for i in range(3)] + [(300, text(), "pt", None)]
    junk = " ".join(f"w%%%#{k}" for k in range(60))  # no repeated words, so that only its distance tells
    rows += [(900, junk, "es", "s3"), (901, junk, None, "s1"), (902, junk, "pt", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for part in (df, df.where("lang is null or lang = 'pt'")):  # the latter is too few rows for any group
        got = part.count(), rules.judge(part).collect()
        assert got[0] == len(got[1]) and all(r.distance is not None for r in got[1])
    kept = {r.doc_id: r.kept for r in rules.judge(df).collect()}
    assert not (kept[900] or kept[901] or kept[902]) and all(kept[i] for i, *_ in rows if i < 900)


def test_quality(spark):
    rng = np.random.default_rng(3)
    good = [(i, " ".join("".join(rng.choice(list("aeiourst"), int(rng.integers(2, 9)))) for _ in range(40)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join("".join(rng.choice(list("AEIOURST"), int(rng.integers(2, 9)))) + "!!" for _ in range(40))) for i in range(120)]
    rows = good + bad + [(5000, None), (5001, ""), (5002, "x" * 200000)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0, 9.0) for i, _ in good + bad] + [(3, None, 0, 1.0), (None, 1, 0, 1.0), (4, 1, 0, 1.0)], "doc_id long, quality int, toxic int, score double")
    got = {r.doc_id: r for r in quality.classify(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [r for i, r in got.items() if r.held_out and i < 5000]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert len(held) > 40 and np.mean([r.predicted == int(r.doc_id < 1000) for r in held]) > 0.97
    kept = {r.doc_id for r in quality.keep_good(docs(spark, rows), labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs(spark, rows[:9]), none).collect()} == {0.5} and quality.classify(docs(spark, rows).limit(0), labels).count() == 0


def test_forest_matches_its_trees():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x, y)
    plain = []
    for row in x:
        total = forest.start
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        plain.append(1 / (1 + np.exp(-total)))
    assert np.allclose(forest.score(x), plain) and ((forest.score(x) > 0.5) == y).mean() > 0.97


def plain_boosting(x, y, trees, depth):
    """Raw scores of x by boosted trees that try every split of every leaf, one row at a time."""
    start = np.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))
    raw = np.full(len(y), start)
    edges = [sorted({np.sort(c)[int(np.floor((len(c) - 1) * k / quality.BINS))] for k in range(1, quality.BINS)}) for c in x.T]

    def grow(rows, level, g, h):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (0.0, None)
        for f in range(x.shape[1]) if level < depth else ():
            for cut in edges[f]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) < quality.LEAF:
                    continue
                part = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.RIDGE)
                gain = part(left) + part(right) - gs**2 / (hs + quality.RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, (left, right))
        if best[1] is None:
            return {int(i): -quality.RATE * gs / (hs + quality.RIDGE) for i in rows}
        return grow(best[1][0], level + 1, g, h) | grow(best[1][1], level + 1, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        step = grow(np.arange(len(y)), 0, p - y, p * (1 - p))
        raw = raw + np.array([step[i] for i in range(len(y))])
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize("ties", [False, True])
def test_fit_equals_exhaustive_boosting(monkeypatch, ties):
    monkeypatch.setattr(quality, "TREES", 4)
    rng = np.random.default_rng(22)
    x = rng.normal(size=(150, 3))
    if ties:
        x = np.round(x)
        x[:, 2] = 1.0
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.5, 150) > 0.4).astype(float)
    assert np.allclose(quality.fit(x, y).score(x), plain_boosting(x, y, 4, quality.DEPTH), atol=1e-9)


ODD = ["", " ", "  a  b   c ", "a\n\n b  \n c", "<|endoftext|> x <|endoftext|>y", "a <|endo ftext|>", "\t   x　 y  ", "it's  don't 12 34..  !!", "\U0001f600 é́ ‍", "a" * 3000, "x y \u0085 z", "  \n  \n"]


def test_tokens(spark):
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(ODD)]
    library = tokens.tokenizer(tokens.default_path())
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    got = {r.doc_id: r for r in tokens.count_tokens(docs(spark, rows)).collect()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == want and all(r.over_limit == (r.n_tokens > 1024) for r in got.values())
    for _, t in rows:
        assert tokens.token_ids(t, tokens.default_path()).tolist() == library.encode(t or "", add_special_tokens=False).ids
        assert "".join(tokens.pieces(t or "")) == (t or "")
    assert tokens.count_tokens(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("gap", [" \u00a0" * k + end for k in (1, 2, 3, 4, 8, 16) for end in ("", " ", "\n", "\u3000 ")] + ["\t ", " \n \u2003 ", "\u0085 ", "\x1f ", "\u1680 \u2028 "])
def test_pieces_keep_mixed_white_space(gap):
    """A space after other white space doesn't begin a pre-token, so the pieces' tokens sum to the text's."""
    count = tokens._lengths(tokens.default_path())
    for t in (f"x{gap}y", f"{gap}y z", f"x{gap}", f"x {gap} {gap}'s 1"):
        got = tokens.pieces(t)
        assert "".join(got) == t and sum(count(got)) == count([t])[0], t


def test_mixed_white_space_is_counted_whole(spark):
    text = "x" + " \u00a0" * 16 + "y"
    got = tokens.count_tokens(docs(spark, [(1, text)])).first()
    assert got.n_tokens == len(tokens.tokenizer(tokens.default_path()).encode(text, add_special_tokens=False).ids)


def test_rank_encoder_equals_library_on_random_strings():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    library = tokens.tokenizer(tokens.default_path())
    letters = st.text(alphabet=st.sampled_from(list("aetoinsrhAT '.,!0123\n\t \u00a0\u3000\u0085\u2028 éßñ  中文\U0001f600<|>")), max_size=60)

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=60), letters))
    def check(t):
        t = t.encode("utf-8", "ignore").decode()
        want = library.encode(t, add_special_tokens=False).ids
        assert tokens.token_ids(t, tokens.default_path()).tolist() == want
        assert sum(n for n in tokens._lengths(tokens.default_path())(tokens.pieces(t))) == len(want)

    check()


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\u00a0", "\u3000", "\u0085", "\u2028", " \u00a0", "\n "])
def test_very_long_white_space(spark, space):
    """Runs beyond what the rank encoder can cut get the library's ids."""
    text = "a b" + space * 1_100_000 + "c d."
    want = tokens.tokenizer(tokens.default_path()).encode(text, add_special_tokens=False).ids
    assert tokens.token_ids(text, tokens.default_path()).tolist() == want


def test_very_long_white_space_is_packed_and_counted(spark):
    rows = [(k, "a b" + space * 1_100_000 + "c d.") for k, space in enumerate((" ", "\u00a0"))] + [(7, "x" * 1_100_000), (8, "-" * 1_100_000)]
    want = {i: tokens.tokenizer(tokens.default_path()).encode(t, add_special_tokens=False).ids for i, t in rows}
    got = {}
    for r in packing.pack(docs(spark, rows), with_ids=True).collect():
        got.setdefault(r.doc_id, {})[r.start] = r.ids
    assert {i: [x for _, p in sorted(parts.items()) for x in p] for i, parts in got.items()} == {i: [*ids, 1] for i, ids in want.items()}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs(spark, rows)).collect()} == {i: len(ids) for i, ids in want.items()}


def test_table_from_a_sample(spark, monkeypatch):
    """The table holds the sample's frequent pieces; counts are the library's whatever the sample held."""
    rows = [(i, f"common words {'rare' * (i % 5)} w{i} \u00e9") for i in range(300)] + [(900, None), (901, ""), (902, "long " * 9000)]
    library = tokens.tokenizer(tokens.default_path())
    table = tokens.frequent(docs(spark, rows), tokens.default_path()).lookup()
    assert table["common"] == len(library.encode("common", add_special_tokens=False).ids) and " w7" in table and " long" not in table
    assert len(tokens.sample(docs(spark, rows), 30)) < 80 and tokens.sample(docs(spark, rows).limit(0)) == []
    monkeypatch.setattr(tokens, "SAMPLE_ROWS", 1)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs(spark, rows)).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    plan = tokens.count_tokens(docs(spark, rows, extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_cache_turns():
    cache = tokens.Pieces(lambda part: [len(p) for p in part], entries=3)
    for k in range(20):
        cache.fill([f"{k}", f"{k + 1}"])
        assert cache.young[f"{k}"] == len(str(k))
        cache.turn()
        assert len(cache.young) <= 3 + 2


def check_packing(rows, window=2048):
    library = tokens.tokenizer(tokens.default_path())
    return {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}, window


def test_packing(spark):
    rows = corpus()
    want, window = check_packing(rows)
    got = packing.pack(docs(spark, rows)).collect()
    pieces, sequences = {}, {}
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for i, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == len(want[i])
    for p in sequences.values():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at <= window and at & (at - 1) == 0
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0
    assert packing.pack(docs(spark, [(None, "a"), (None, "a")])).count() == 2
    whole = packing.pack(docs(spark, rows), with_ids=True).where("doc_id = 204").first()
    assert whole.ids == want[204]


@pytest.mark.parametrize("sizes", [[1500] * 3000, [1] * 5000, [2048] * 5, [2047] * 2000, list(range(1, 2048)) * 2])
def test_packer_bounds(sizes):
    """Windows held stay bounded, and nothing is padded, whatever the sizes."""
    done = []
    packer = packing.Packer(lambda n, p: done.append(sum(len(x[2]) // 4 for x in p)), most_open=64)
    for i, n in enumerate(sizes):
        packer.add(i, b"\0\0\0\1" * n)
        assert packer.open <= 65
    packer.close()
    assert sum(done) == sum(sizes) and sum(n != 2048 for n in done) <= 11 and all(n & (n - 1) == 0 for n in done)


def test_packer_places_by_sum_of_squares():
    """Each placement is one that leaves the least sum of squared counts."""
    rng = np.random.default_rng(5)
    packer = packing.Packer(lambda n, p: None, window=16, most_open=10_000)
    for i, n in enumerate(rng.integers(1, 16, 400)):
        before = packer.count.copy()
        options = []
        for h in range(16 - n + 1):
            if h and not before[h]:
                continue
            c = before.copy()
            if h:
                c[h] -= 1
            if h + n < 16:
                c[h + n] += 1
            options.append(int((c[1:16] ** 2).sum()))
        packer.place((i, 0, b"\0\0\0\1" * int(n), int(n)), int(n))
        assert int((packer.count[1:16] ** 2).sum()) == min(options)


def test_words_helper():
    assert words("A b\x0bC") == ["a", "b", "c"]
