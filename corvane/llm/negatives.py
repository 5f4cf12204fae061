"""Hard negatives by blocks of rows on a Hilbert curve, their zone maps and interval arithmetic.

Components become floor(256 x). Rows are ordered by label, then by their place on a Hilbert curve
through the CURVE components of greatest variance (BITS bits each, between the observed mean and
its spread), and written as Parquet in blocks of BLOCK_ROWS rows at most, each with the least and
greatest value of every component (its zone map) and of the label. A read of zone maps alone
reads these few columns. Anchors are taken out of the blocks in the same order and held in tiles of
TILE_ROWS.

A search has a window of scores for each anchor. For anchor a and a block between lo and hi, the score of
any row lies between sum(min(a lo, a hi)) and sum(max(a lo, a hi)); a block is read for a tile only if that
interval meets the window of one of its anchors and the labels allow it. Chosen blocks meet their
tile in tasks of about PART_BLOCKS blocks, greatest bound first, where the k-th best score found so far
narrows the window; rows are scored by one product of matrices, for the anchors that still
need the block. Two searches are made: nearest rows of the same label (their window begins at the
k-th best score within the anchor's own block), then, per anchor, one window for each positive, all scored
in one product. Best rows of several tasks are ranked by a window that is cut at k while it sorts.

Every row that may count is scored, and scores are exact: products are taken in 32-bit floats while no
sum can reach 2^24, in 64-bit ones below 2^53, else in 64-bit integers. On vectors without
structure bounds exclude little but blocks of other labels, and the work is that of all rows
for each anchor, in blocks; on clustered ones most blocks go unread (a test counts them).
Tiles and blocks have a stated size, so that memory doesn't grow with a label, a copy's group or the table.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
components are held within 2^24 either way, so that a score fits 64 bits; missing trailing components
count as 0; repeated rows are rows of their own, and repeated anchors have results of their own, but no
row of the anchor's id is its positive; an anchor without positives, or a positive without
negatives, has no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import common

POSITIVES, NEGATIVES, EVERY = 5, 3, 50
#: Components on the curve, and bits of each: 60 bits in all.
CURVE, BITS = 15, 4
#: Rows of a block and of a tile, and bytes of their vectors at most.
BLOCK_ROWS, TILE_ROWS, BLOCK_BYTES = 1024, 4096, 4 << 20
#: Fewest rows of a block that ends where a label does.
LEAST_ROWS = 64
#: Zone maps that a tile is compared with at a time, blocks that a task scores for a tile, and scores at a time.
ZONES, PART_BLOCKS, SCORES = 64, 64, 1 << 22
HELD = 1 << 24
_FAR = 1 << 62

_BLOCK = "block long, n int, span binary, low binary, high binary, ids binary, labels binary, vectors binary"
_TILE = "tile long, n int, ids binary, labels binary, vectors binary, low binary, high binary"


def _ints(x) -> bytes:
    return np.ascontiguousarray(x, "<i8").tobytes()


def _long(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(rows, -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of a and of b, exact, as 64-bit integers or floats that hold them."""
    top = max(a.shape[1], 1) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score that each row of a can have in each zone."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    wide = lambda x: x.astype(np.int64 if x.dtype == np.int64 else np.float64)
    return wide(product(up, low)) + wide(product(down, high)), wide(product(up, high)) + wide(product(down, low))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each point (integers below 2^bits, a row each) on a Hilbert curve through the cube."""
    x = points.T.astype(np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the turns of each level, from the coarsest on
        rest = bit - 1
        for i in range(len(x)):
            high = (x[i] & bit) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & rest)
            x[0] ^= np.where(high, rest, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros_like(x[-1]), 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    place = np.zeros(points.shape[0], np.int64)
    for level in range(bits - 1, -1, -1):
        for one in x:
            place = place << 1 | (one >> level) & 1
    return place


def rows_of(embeddings: DataFrame) -> DataFrame:
    """(id, label, v): the rows that take part, their changed labels and integer components."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    label = F.col("label").cast("long")
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(HELD)), F.lit(-HELD)).cast("int"))
    return kept.select(F.col("vec_id").cast("long").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("v"))


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as a matrix, zeros after their ends."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    out = np.zeros((len(sizes), width), np.int32)
    if len(sizes):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _spread(rows: DataFrame) -> dict[int, tuple[float, float]]:
    """Mean and deviation of every component; one small row a component reaches the driver."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                m = _padded(batch.column(0), int(np.diff(batch.column(0).offsets).max())).astype(float)
                for j, part in enumerate(np.stack([np.full(m.shape[1], len(m)), m.sum(0), (m * m).sum(0)], 1)):
                    held[j] = held.get(j, 0) + part
        if held:
            yield pa.RecordBatch.from_pydict({"j": pa.array(list(held), pa.int32())} | {c: [float(p[k]) for p in held.values()] for k, c in enumerate("nsq")})

    total = rows.select("v").mapInArrow(run, "j int, n double, s double, q double").groupBy("j").agg(*[F.sum(c).alias(c) for c in "nsq"])
    return {r.j: (r.s / r.n, max(r.q / r.n - (r.s / r.n) ** 2, 0.0) ** 0.5) for r in total.collect()}


def blocks_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """The table of blocks, written, and the number of components."""
    spread = _spread(rows)
    width = len(spread)
    chosen = sorted(sorted(spread, key=lambda j: (-spread[j][1], j))[:CURVE])
    mean, wide = (np.array([spread[j][k] for j in chosen]) for k in (0, 1))

    def placed(batches):
        for batch in batches:
            m = _padded(batch.column(2), width)[:, chosen]
            cell = np.clip(np.floor((m - mean) / np.where(wide > 0, wide, 1) * (1 << BITS) / 4) + (1 << (BITS - 1)), 0, (1 << BITS) - 1)  # two deviations either way
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cell) if chosen else np.zeros(batch.num_rows, np.int64))], names=["id", "label", "v", "place"])

    most = max(LEAST_ROWS, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(width, 1))))

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, labels, vectors = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int32)

        def block(a, b):
            nonlocal number
            order = a + np.argsort(ids[a:b], kind="stable")
            v, number = vectors[order], number + 1
            return (number, b - a, _ints([labels[order].min(), labels[order].max()]), v.min(0).tobytes(), v.max(0).tobytes(), _ints(ids[order]), _ints(labels[order]), v.tobytes())

        def told(done):
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int32(), *[pa.binary()] * 6))], names=_names(_BLOCK))

        for batch in batches:
            ids, labels = np.append(ids, batch.column(0).to_numpy()), np.append(labels, batch.column(1).to_numpy())
            vectors, a, done = np.concatenate([vectors, _padded(batch.column(2), width)]), 0, []
            while a < len(ids):
                ends = np.flatnonzero(labels[a + 1 : a + most] != labels[a : a + most - 1][: len(labels[a + 1 : a + most])]) + a + 1
                ends = ends[ends - a >= LEAST_ROWS]
                b = int(ends[0]) if len(ends) else a + most
                if b > len(ids):
                    break
                done.append(block(a, b))
                a = b
            ids, labels, vectors = ids[a:], labels[a:], vectors[a:]
            if done:
                yield told(done)
        if len(ids):
            yield told([block(0, len(ids))])

    ordered = rows.mapInArrow(placed, "id long, label long, v array<int>, place long").repartitionByRange("label", "place", "id").sortWithinPartitions("label", "place", "id")
    return common.written(ordered.select("id", "label", "v").mapInArrow(cut, _BLOCK), "blocks"), width


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class _Best:
    """The k best rows of each anchor and window found so far."""

    def __init__(self, row: dict, k: int, same: bool):
        n = row["n"]
        self.ids, self.labels, self.vectors = _long(row["ids"]), _long(row["labels"]), _matrix(row["vectors"], n)
        self.low, self.high, self.same, self.k = _long(row["low"]).reshape(n, -1).copy(), _long(row["high"]).reshape(n, -1), same, k
        self.score, self.found = np.full((*self.low.shape, k), -_FAR), np.zeros((*self.low.shape, k), np.int64)

    def allowed(self, span: np.ndarray) -> np.ndarray:
        """For which anchors a block whose labels span these may hold rows."""
        inside = (self.labels >= span[0]) & (self.labels <= span[1])
        return inside if self.same else (span[0] != span[1]) | ~inside

    def read(self, row: dict) -> None:
        """Take in a block, for the anchors whose windows it can meet."""
        least, most = bounds(self.vectors, _matrix(row["low"], 1), _matrix(row["high"], 1))
        need = np.flatnonzero(((most >= self.low) & (least <= self.high)).any(1) & self.allowed(_long(row["span"])))
        ids, labels, vectors = _long(row["ids"]), _long(row["labels"]), _matrix(row["vectors"], row["n"])
        step = max(1, SCORES // len(ids))
        for a in range(0, len(need), step):
            rows = need[a : a + step]
            scores = product(self.vectors[rows], vectors)
            fits = (self.labels[rows, None] == labels) == self.same
            if self.same:
                fits &= self.ids[rows, None] != ids
            for w in range(self.low.shape[1]):
                i, j = np.nonzero(fits & (scores >= self.low[rows, w, None]) & (scores <= self.high[rows, w, None]))
                if len(i):
                    self._merge(rows[i], w, scores[i, j].astype(np.int64), ids[j])

    def _merge(self, i: np.ndarray, w: int, score: np.ndarray, found: np.ndarray) -> None:
        touched = np.unique(i)
        i, score, found = np.append(np.repeat(touched, self.k), i), np.append(self.score[touched, w].ravel(), score), np.append(self.found[touched, w].ravel(), found)
        order = np.lexsort((found, -score, i))
        i, score, found = i[order], score[order], found[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < self.k
        self.score[i[top], w, rank[top]], self.found[i[top], w, rank[top]] = score[top], found[top]
        self.low[touched, w] = np.maximum(self.low[touched, w], self.score[touched, w, -1])

    def told(self, tile: int) -> pa.RecordBatch:
        i, w, r = np.nonzero(self.score > -_FAR)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), tile)), pa.array(i.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(self.ids[i]), pa.array(self.score[i, w, r]), pa.array(self.found[i, w, r])], names=["tile", "i", "w", "anchor", "score", "id"])


def tiles_of(blocks: DataFrame, width: int, every: int, k: int) -> DataFrame:
    """Anchors in tiles, written, each with a window that begins at its k-th best score within its own block."""
    most = max(1, min(TILE_ROWS, BLOCK_BYTES // (4 * max(width, 1))))

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def tile():
            nonlocal number, held, size
            number += 1
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size], pa.int32()), *[pa.array([b"".join(h[k] for h in held)], pa.binary()) for k in range(5)]], names=_names(_TILE))
            held, size = [], 0
            return out

        for batch in batches:
            for row in batch.to_pylist():
                pick = np.flatnonzero(_long(row["ids"]) % every == 0)
                for a in range(0, len(pick), most):
                    part = pick[a : a + most]
                    if size + len(part) > most:
                        yield tile()
                    one = {"n": len(part), "ids": _ints(_long(row["ids"])[part]), "labels": _ints(_long(row["labels"])[part]), "vectors": _matrix(row["vectors"], row["n"])[part].tobytes()}
                    one |= {"low": _ints(np.full(len(part), -_FAR)), "high": _ints(np.full(len(part), _FAR))}
                    home = _Best(one, k, True)
                    home.read(row)
                    held.append((one["ids"], one["labels"], one["vectors"], _ints(home.low), one["high"]))
                    size += len(part)
        if size:
            yield tile()

    return common.written(blocks.mapInArrow(run, _TILE), "tiles")


def choose(tiles: DataFrame, blocks: DataFrame, n_blocks: int, k: int, same: bool) -> DataFrame:
    """(tile, block, bound): the blocks that a tile's windows must read, and their greatest possible score."""
    groups = -(-n_blocks // ZONES) or 1
    zones = blocks.select((F.pmod(F.xxhash64("block"), F.lit(groups))).alias("g"), F.struct("block", "span", "low", "high").alias("z")).groupBy("g").agg(F.collect_list("z").alias("zones"))  # about ZONES small rows
    rows = tiles.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))).join(zones, "g").drop("g")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                best, zones = _Best(row, k, same), row["zones"]
                low, high = (np.concatenate([_matrix(z[c], 1) for z in zones]) for c in ("low", "high"))
                may = np.stack([best.allowed(_long(z["span"])) for z in zones], 1)
                least, most = bounds(best.vectors, low, high)
                meets = np.zeros(may.shape, bool)
                for w in range(best.low.shape[1]):
                    meets |= (most >= best.low[:, w, None]) & (least <= best.high[:, w, None])
                need = meets & may
                hit = np.flatnonzero(need.any(0))
                bound = np.where(need, most, -_FAR).max(0)[hit].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), row["tile"])), pa.array([zones[h]["block"] for h in hit], pa.int64()), pa.array(bound)], names=["tile", "block", "bound"])

    return rows.mapInArrow(run, "tile long, block long, bound long")


def search(tiles: DataFrame, blocks: DataFrame, n_blocks: int, k: int, same: bool) -> DataFrame:
    """(tile, i, w, anchor, score, id, rank): the k best rows of anchor i and window w of each tile."""
    parts = -(-n_blocks // PART_BLOCKS) or 1
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias("part")
    chosen = choose(tiles, blocks, n_blocks, k, same).join(blocks, "block").select("tile", part("block"), F.lit(1).alias("kind"), (-F.col("bound")).alias("place"), "n", "span", "low", "high", "ids", "labels", "vectors")
    asking = tiles.select("tile", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), "n", F.lit(None).cast("binary").alias("span"), "low", "high", "ids", "labels", "vectors")
    met = chosen.unionByName(asking).repartition("tile", "part").sortWithinPartitions("tile", "part", "kind", "place")

    def run(batches):
        best = tile = None
        for batch in batches:
            for i in range(batch.num_rows):  # one row of megabytes at a time
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    if best is not None:
                        yield best.told(tile)
                    best, tile = _Best(row, k, same), row["tile"]
                else:
                    best.read(row)
        if best is not None:
            yield best.told(tile)

    found = met.mapInArrow(run, "tile long, i int, w int, anchor long, score long, id long")
    rank = F.row_number().over(W.partitionBy("tile", "i", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _windows(tiles: DataFrame, positives: DataFrame, most: int) -> DataFrame:
    """The tiles with a window for each positive: half to 95% of its score."""
    scores = positives.groupBy("tile").agg(F.collect_list(F.struct("i", "rank", "score")).alias("positives"))  # of at most TILE_ROWS anchors

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                low, high = np.ones((row["n"], most), np.int64), np.zeros((row["n"], most), np.int64)
                i, r, s = np.array([(p["i"], p["rank"] - 1, p["score"]) for p in row["positives"]], np.int64).T
                low[i, r], high[i, r] = -(-s // 2), (s // 20) * 19 + (s % 20) * 19 // 20
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("tile", "n", "ids", "labels", "vectors")}, "low": _ints(low), "high": _ints(high)}], schema=pa.schema(list(zip(_names(_TILE), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True))))

    return tiles.select("tile", "n", "ids", "labels", "vectors").join(scores, "tile").mapInArrow(run, _TILE)


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor (id divisible by `every`)."""
    blocks, width = blocks_of(rows_of(embeddings))
    n_blocks = blocks.count()
    tiles = tiles_of(blocks, width, every, positives)
    near = common.written(search(tiles, blocks, n_blocks, positives, True), "positives")
    windows = common.written(_windows(tiles, near, positives), "windows")
    found = search(windows, blocks, n_blocks, negatives, False).select("tile", "i", (F.col("w") + 1).alias("w"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ends = near.select("tile", "i", F.col("rank").alias("w"), F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(ends, ["tile", "i", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND length(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.id % {EVERY} = 0 WHERE a.label <> b.label OR a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= {NEGATIVES}"""
