"""Hard negatives and whitening against plain versions, on odd rows, clusters and empty tables."""

import numpy as np
import pytest

from corvane.llm import negatives, whitening

SCHEMA = "vec_id long, label int, embedding array<float>, rank int, score string, x string, tile string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, g, v, 1, "s", "x", "t", "n") for i, g, v in rows], SCHEMA).repartition(3)


def vectors(seed, n, width, clusters=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.3, (n, width))
    if clusters:
        at = rng.normal(0, 1, (clusters, width))
        v = at[rng.integers(0, clusters, n)] + v / 10
    return v.astype(np.float32)


def odd_rows(seed=0, n=700, width=6, clusters=0):
    v = vectors(seed, n, width, clusters)
    rows = [(i, int(i * i % 4), v[i].tolist()) for i in range(n)]
    rows += [(1000 + i, 0, v[3].tolist()) for i in range(60)]  # ties
    rows += [rows[50], rows[50], rows[51], (None, 1, v[0].tolist()), (2000, None, v[0].tolist()), (2050, 1, None), (2100, 1, [None] * width), (2150, 1, [float("nan")] + v[0].tolist()[1:]), (2200, 1, [float("inf")] + v[0].tolist()[1:])]
    return rows + [(2250, 2, []), (2300, 1, v[1].tolist()[:3]), (2350, 7, v[2].tolist())]


def plain_negatives(rows, every=50):
    width = max((len(v) for _, _, v in rows if v), default=0)
    sound = [(i, (g + 1) % 10 if i % 7 == 0 else g, [max(-(1 << 24), min(1 << 24, int(np.floor(256 * float(np.float32(x)))))) for x in v] + [0] * (width - len(v))) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    m = np.array([v for _, _, v in sound], np.int64).reshape(len(sound), -1 if sound and width else 0)
    out = []
    for (i, g, _), v in zip(sound, m, strict=True):
        if i % every:
            continue
        scores = sorted((-int(s), j, h) for s, (j, h, _) in zip(m @ v, sound, strict=True))
        for s, j, _ in [x for x in scores if x[2] == g and x[1] != i][:5]:
            fit = [x for x in scores if x[2] != g and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "clusters"), [(0, 0), (1, 8)])
def test_negatives(spark, monkeypatch, seed, clusters):
    rows = odd_rows(seed, clusters=clusters)
    df = negatives.mine(table(spark, rows))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert len(want) > 50 and sorted(map(tuple, df.collect())) == want


def test_negatives_in_small_blocks(spark, monkeypatch):
    """The same rows whatever the sizes of blocks, tiles and tasks; clustered blocks go unread."""
    for name, size in {"BLOCK_ROWS": 64, "TILE_ROWS": 5, "ZONES": 3, "PART_BLOCKS": 2, "SCORES": 200, "LEAST_ROWS": 4}.items():
        monkeypatch.setattr(negatives, name, size)
    rows = odd_rows(2, 900, clusters=12)
    assert sorted(map(tuple, negatives.mine(table(spark, rows)).collect())) == plain_negatives(rows)
    blocks, width = negatives.blocks_of(negatives.rows_of(table(spark, rows)))
    n = blocks.count()
    tiles = negatives.tiles_of(blocks, width, 50, 5)
    assert negatives.choose(tiles, blocks, n, 5, True).count() < 0.5 * n * tiles.count()


@pytest.mark.parametrize("rows", [[], [(0, 1, [1.0])], [(0, 1, None)], [(0, 1, []), (1, 1, []), (2, 2, [])], [(0, 1, [3e38, 1.0]), (1, 1, [3e38, -1.0]), (2, 2, [2e4, 0.0])]])
def test_negatives_of_few(spark, rows):
    assert sorted(map(tuple, negatives.mine(table(spark, rows)).collect())) == plain_negatives(rows)


def test_hilbert_curve_visits_neighbours():
    """Every cell has a place of its own, and the next place is a neighbouring cell."""
    for width, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), -1).reshape(-1, width)
        place = negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for top in (10, 1 << 13, 1 << 24):
        a, b = rng.integers(-top, top, (7, 33)), rng.integers(-top, top, (9, 33))
        assert (negatives.product(a.astype(np.int32), b.astype(np.int32)).astype(np.int64) == a @ b.T).all()


def plain_whitening(rows):
    width = max(len(v) for _, _, v in rows if v is not None)
    sound = [(i, v) for i, _, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in sound])
    lengths = {(tuple(r), len(v)) for r, (_, v) in zip(x.tolist(), sound, strict=True)}
    f = np.array([r for r, _ in sorted(lengths)])
    n, s = len(f), f.sum(0)
    z = f - s / n
    value, turn = np.linalg.eigh(z.T @ z / n)
    value, turn = value[::-1][:16], turn[:, ::-1][:, :16]
    return [i for i, _ in sound], n, ((n * x - s) ** 2).sum(1), np.abs((x - s / n) @ turn / np.sqrt(value)), value / (z * z).sum() * n


@pytest.mark.parametrize("width", [6, 20])
def test_whitening(spark, width):
    rows = odd_rows(3, 400, width)
    df = whitening.whiten(table(spark, rows))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id if r.vec_id is not None else -1, r.deviation), []).append(r)
    ids, n, deviation, y, share = plain_whitening(rows)
    k = min(width, 16)
    assert sum(map(len, got.values())) == k * len(ids)
    for i, d, row in zip(ids, deviation.tolist(), y, strict=True):
        found = sorted(got[(-1 if i is None else i, d)], key=lambda r: r.component)[:: len(got[(-1 if i is None else i, d)]) // k]
        assert [r.component for r in found] == list(range(1, k + 1)) and {r.n for r in found} == {n}
        assert np.allclose(np.abs([r.whitened for r in found]), row, atol=1e-8) and np.allclose([r.explained for r in found], share, rtol=1e-9)
    assert max(r.identity_error for g in got.values() for r in g) < 1e-9


def test_whitening_of_few(spark):
    """No rows; one vector; a component without variance; entries whose squares need more than 64 bits."""
    assert whitening.whiten(table(spark, [])).collect() == [] and whitening.whiten(table(spark, [(1, 1, None), (2, 1, [])])).collect() == []
    one = whitening.whiten(table(spark, [(1, 1, [0.5, 0.25]), (2, 1, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.explained == 0 and r.identity_error == 0 for r in one)
    flat = sorted(whitening.whiten(table(spark, [(1, 1, [0.5, 1.0]), (2, 1, [1.0, 1.0]), (None, 1, [2.0, 1.0])])).collect(), key=lambda r: (str(r.vec_id), r.component))
    assert [r.whitened is None for r in flat] == [False, True] * 3 and flat[0].explained == 1
    large = whitening.whiten(table(spark, [(1, 1, [1e30, 0.0]), (2, 1, [-1e30, 1.0]), (3, 1, [5.0, 2.0])])).collect()
    assert {r.deviation is None for r in large if r.vec_id == 1} == {True} and large[0].identity_error < 1e-4


@pytest.mark.parametrize("values", [np.ones(24), np.r_[1 + 1e-9 * np.arange(8), 0.5 + 1e-12 * np.arange(8), np.linspace(0.1, 0.4, 8)], 1 + 1e-6 * np.arange(24), 10.0 ** -np.arange(24), np.zeros(24)])
def test_eigenvectors_of_clusters(values):
    """Orthonormal to double precision, with small residuals, beyond what 32-bit vectors give."""
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(24, 24)))[0]
    v = (turn * values) @ turn.T
    v = (v + v.T) / 2
    value, x = whitening.eigenvectors(v)
    top = max(np.abs(v).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(24)).max() < 1e-14 and np.abs(v @ x - x * value).max() < 2e-14 * top + 1e-300
    assert (np.diff(value) <= 0).all() and np.allclose(value, np.sort(values)[::-1], atol=1e-13)


def test_exact_products():
    z = np.random.default_rng(9).integers(-(1 << 31), 1 << 31, (50, 4))
    want = z.astype(object).T @ z.astype(object)
    assert (whitening.exact_products(z) == want).all() and (whitening.exact_products(z >> 20) == (z >> 20).T @ (z >> 20)).all()
