"""Whitening of embeddings by refined eigenvectors of their distributed covariance.

Components become x = floor(64 c) + 1000000. The fit list holds each distinct vector once. Its number n and
sums S are whole numbers; its products are summed about the whole number nearest to S / n and corrected by
the remainder, all in exact integers, so that every entry of the covariance is rounded once, and no
order of tasks or partitions changes a bit of the result. Each task gives one row per pair of
components, summed by key; what reaches the driver is one row a pair, however many vectors there are.

Eigenvectors begin as those that 32-bit arithmetic finds. Ogita-Aishima steps then correct them by products of
matrices in extended precision: with R = I - X'X and S = X'VX, each pair of columns is mended by
(S_ij + l_j R_ij) / (l_j - l_i), or by R_ij / 2 where eigenvalues lie too close for that; columns of
such a cluster are turned by the eigenvectors of V within their span, shifted by the cluster's
mean and scaled, and mended again. Steps go on until the correction is below the rounding of a double or halves
no more. Equal eigenvalues leave their vectors free within their span; a sign is fixed by the largest entry.

Rows are whitened one by one in a map-only pass over the whole table, from (n x - S) / n, without a
join. Memory is a batch of rows and a few matrices of components by components.

Cases: rows with a null vector, or a null or non-finite entry, are dropped; a null id stays as it is;
repeated rows are whitened each, and count once for the fit; x is held within 2^30 or so either way; missing
trailing components count as c = 0 (vectors that differ in length alone are distinct); a deviation beyond 64 bits is null; a component without
variance (eigenvalue at or below rounding) has a null whitened value, explained 0, and doesn't
count in identity_error, which is 0 if all have none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

MOST, SCALE, SHIFT, HELD = 16, 64, 1_000_000, 1 << 30
#: Rows that are multiplied at a time, and steps of refinement at most.
ROWS, STEPS = 4096, 40
_WIDE = np.longdouble


def whole(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that take part and their whole-number vectors."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(HELD - SHIFT)), F.lit(-HELD)) + SHIFT
    return embeddings.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("embedding", held).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as a matrix, SHIFT after their ends."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(sizes), width), SHIFT, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by component."""

    def run(batches):
        total, n = np.zeros(width, object), 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total, n = total + x.sum(0).astype(object), n + len(x)  # 64 bits hold a batch's sum
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, width), pa.int32()), "s": [str(v) for v in (n, *total)]})

    rows = fit.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    held = {r.i: int(r.s) for r in rows}
    return held.get(-1, 0), [held.get(j, 0) for j in range(width)]


def exact_products(z: np.ndarray) -> np.ndarray:
    """z'z of whole numbers: by 64-bit floats in blocks of rows whose sums they hold, else by Python's integers."""
    top = float(np.abs(z).max(initial=0)) ** 2
    step = int((1 << 53) // max(top, 1.0))
    if step < 1:
        z = z.astype(object)
        return z.T @ z
    out = np.zeros((z.shape[1],) * 2, object)
    for a in range(0, len(z), min(step, ROWS)):
        part = z[a : a + min(step, ROWS)].astype(float)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def covariance(fit: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the fit list, each entry exact but for one rounding."""
    middle = [(2 * s + n) // (2 * n) for s in sums]
    at = np.array(middle, np.int64)
    upper = [(i, j) for i in range(width) for j in range(i, width)]

    def run(batches):
        total = np.zeros((width, width), object)
        for batch in batches:
            total = total + exact_products(_matrix(batch.column(0), width) - at)
        yield pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in upper], pa.int32()), "j": pa.array([j for _, j in upper], pa.int32()), "s": [str(total[i, j]) for i, j in upper]})

    rows = fit.mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    out = np.zeros((width, width))
    for r in rows.collect():
        out[r.i, r.j] = out[r.j, r.i] = (n * int(r.s) - rest[r.i] * rest[r.j]) / (n * n)  # a quotient of integers is rounded once
    return out


def _groups(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of sorted values, each of two or more, whose neighbours are no more than gap apart."""
    order = np.argsort(values, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1) if len(g) > 1]


def _mend(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step: the corrected vectors, the eigenvalues, the size of the correction, the gap of a cluster."""
    r = np.eye(len(a), dtype=_WIDE) - x.T @ x
    s = x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.sqrt((m * m).sum()))
    gap = 2 * (norm(s - np.diag(value)) + float(np.abs(value).max(initial=0)) * norm(r))
    apart = value[None, :] - value[:, None]
    far = np.abs(apart) > gap
    e = np.where(far, (s + value[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ e, value, norm(e), gap


def _sub_solve(a: np.ndarray, x: np.ndarray, value: np.ndarray, gap: float) -> np.ndarray:
    """Turn the columns of each cluster to the eigenvectors of a within their span."""
    for group in _groups(value.astype(float), gap):
        mean = value[group].mean()
        part = x[:, group].T @ (a @ x[:, group] - mean * x[:, group])
        part = (part + part.T) / 2
        top = np.abs(part).max()
        if top > 0:
            x[:, group] = x[:, group] @ np.linalg.eigh((part / top).astype(float))[1].astype(_WIDE)
    return x


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    top = float(np.abs(v).max(initial=0)) or 1.0
    a = v.astype(_WIDE) / top
    x = np.linalg.eigh((v / top).astype(np.float32))[1].astype(_WIDE)
    last = float("inf")
    for _ in range(STEPS):
        x, value, moved, gap = _mend(a, x)
        if moved < 1e-9:
            x = _sub_solve(a, x, value, gap)
        if moved < 1e-17 or (moved < 1e-13 and moved > last / 2):
            break
        if moved < 1e-6:
            x = _sub_solve(a, x, value, max(gap, 1e-6))
        last = moved
    for _ in range(4):  # the nearest orthonormal columns, which where all is well are these
        x = x + x @ ((np.eye(len(a), dtype=_WIDE) - x.T @ x) / 2)
    value = (x * (a @ x)).sum(0)
    order = np.argsort(-value, kind="stable")
    x, value = x[:, order], value[order]
    x = x * np.sign(x[np.abs(x).argmax(0), np.arange(x.shape[1])])
    return (value * top).astype(float), x.astype(float)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits where they hold it, else in Python's integers."""
    if n * HELD < 1 << 61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(far: np.ndarray) -> list[int | None]:
    """The sums of squares of whole numbers by row; None beyond 64 bits."""
    top = max(abs(int(far.max(initial=0))), abs(int(far.min(initial=0))))
    if far.shape[1] * top * top < 1 << 63:
        return (far.astype(np.int64) ** 2).sum(1).tolist()
    return [d if d < 1 << 63 else None for d in (sum(int(v) ** 2 for v in row) for row in far)]


def _identity_error(fit: DataFrame, width: int, n: int, sums: np.ndarray, turn: np.ndarray) -> float:
    """The largest entry of the covariance of whitened vectors minus the identity."""
    k = turn.shape[1]
    if not k:
        return 0.0

    def run(batches):
        total, held = np.zeros((k + 1, k)), False
        for batch in batches:
            y = (_centred(_matrix(batch.column(0), width), n, sums) / n).astype(float) @ turn
            total[:k] += y.T @ y
            total[k] += y.sum(0)
            held = True
        if held:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(np.arange(k + 1, dtype=np.int32), k)), "j": pa.array(np.tile(np.arange(k, dtype=np.int32), k + 1)), "s": total.ravel()})

    got = np.zeros((k + 1, k))
    for r in fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r.i, r.j] = r.s / n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


_FIELDS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component up to `most`."""
    rows = whole(embeddings)
    fit = common.written(rows.select("x").distinct(), "fit")
    width = fit.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums = _sums(fit, width) if width else (0, [])
    if not n:
        return embeddings.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _FIELDS.split(", "))]).where(F.lit(False))
    v = covariance(fit, width, n, sums)
    value, vectors = eigenvectors(v)
    value, vectors = value[:most], vectors[:, :most]
    spread = value > width * 2.0**-50 * max(float(np.trace(v)), 0.0)
    turn = vectors[:, spread] / np.sqrt(value[spread])
    share = np.where(spread, value / (float(np.trace(v)) or 1.0), 0.0)
    s = np.array(sums, object)
    error = _identity_error(fit, width, n, s, turn)
    common.drop(fit)
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, {_FIELDS}"
    k = len(value)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                far = _centred(_matrix(part.column(1), width), n, s)
                y = np.full((len(far), k), np.nan)
                y[:, spread] = (far / n).astype(float) @ turn
                m = len(far)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviations(far), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(y.ravel(), mask=np.tile(~spread, m)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", *(f.split()[0] for f in _FIELDS.split(", "))],
                )

    return rows.mapInArrow(run, schema)
