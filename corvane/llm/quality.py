"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned at quantiles of the training rows; trees of fixed depth are
grown on gradient histograms of a logistic loss; the forest is flattened into five arrays and
walked for all documents of a batch at once, one level a step.

Training sees at most TRAIN_ROWS labelled rows, those of the smallest hashed ids outside the
held-out fold (crc32(doc_id as text) mod 5 is 0); the bound is a parameter. Scoring is one
map-only pass; the forest is of fixed size, so it may be broadcast whatever the corpus.

Cases: a null or empty text has all statistics zero and is scored like any other; a null id is
not held out and never labelled; of several labels of a document the mean decides, rounded up
from a half, null labels aside; one class only, or no labels, give a constant score; repeated
rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

FOLDS, HELD, CUT = 5, 0, 0.3
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAF, RIDGE = 80, 4, 64, 0.12, 12, 1.0

NAMES = (
    "log_words", "word_bytes", "upper", "symbols", "exclaimed", "barred", "digits", "distinct", "commonest", "echoed",
    "lines", "same_lines", "stops", "commas", "line_words", "beyond_ascii", "capitalised", "entropy", "short",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>", np.uint8)


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text, in the order of NAMES."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    share = count[count > 0] / size
    sizes = list(map(len, words))
    return [
        float(np.log1p(n)), sum(sizes) / n, upper / max(1, upper + lower), float(count[_SYMBOLS].sum()) / n, int(count[33]) / n, int(count[124]) / n,
        int(count[48:58].sum()) / size, len(seen) / n, max(seen.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        len(lines) / n, 1 - len(set(lines)) / len(lines), int(count[46]) / n, int(count[44]) / n, float(np.log1p(n / len(lines))),
        int(count[128:].sum()) / size, sum(map(bytes.istitle, words)) / n, float(-(share * np.log2(share)).sum()), sum(s <= 3 for s in sizes) / n,
    ]


class Forest:
    """Boosted trees in flat arrays; a leaf points to itself."""

    def __init__(self, feature, threshold, left, right, value, roots, start):
        self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.start = feature, threshold, left, right, value, roots, start

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees of depth DEPTH for labels y (0 or 1) on statistics x."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        zero = np.zeros(1, np.int64)
        return Forest(zero, np.zeros(1), zero, zero, np.zeros(1), zero, start)
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width = x.shape[1]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    raw = np.full(len(y), start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        node = np.zeros(len(y), np.int64)  # number within the level; -1 once in a leaf
        ids = [len(feature)]
        for column in (feature, left, right):
            column.append(len(feature) if column is not feature else 0)
        threshold.append(0.0)
        value.append(0.0)
        for depth in range(DEPTH + 1):
            live = node >= 0
            k = len(ids)
            at = node[live]
            gs, hs = np.bincount(at, g[live], k), np.bincount(at, h[live], k)
            best = np.zeros(k)
            split = np.full((k, 2), -1)
            if depth < DEPTH:
                for f in range(width):
                    key = at * BINS + binned[live, f]
                    gl, hl, nl = (np.bincount(key, w, k * BINS).reshape(k, BINS).cumsum(axis=1) for w in (g[live], h[live], None))
                    gr, hr, nr = gs[:, None] - gl, hs[:, None] - hl, nl[:, -1:] - nl
                    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gs**2 / (hs + RIDGE))[:, None]
                    gain[(nl < LEAF) | (nr < LEAF)] = 0
                    gain[:, len(edges[f]) :] = 0
                    b = gain.argmax(axis=1)
                    more = gain[np.arange(k), b] > best + 1e-9
                    best[more], split[more, 0], split[more, 1] = gain[np.arange(k), b][more], f, b[more]
            step = np.full(k, -1)
            grown: list[int] = []
            for j, i in enumerate(ids):
                if split[j, 0] < 0:
                    value[i] = float(-RATE * gs[j] / (hs[j] + RIDGE))
                    continue
                feature[i], threshold[i] = int(split[j, 0]), float(edges[split[j, 0]][split[j, 1]])
                step[j] = len(grown)
                for side in (left, right):
                    new = len(feature)
                    side[i] = new
                    grown.append(new)
                    feature.append(0)
                    threshold.append(0.0)
                    left.append(new)
                    right.append(new)
                    value.append(0.0)
            leaf = np.array([value[i] for i in ids])
            inside = np.flatnonzero(live)
            ends = step[at] < 0
            raw[inside[ends]] += leaf[at[ends]]
            node[inside[ends]] = -1
            on, j = inside[~ends], at[~ends]
            node[on] = step[j] + (binned[on, split[j, 0]] > split[j, 1])
            ids = grown
            if not ids:
                break
    return Forest(*map(np.array, (feature, threshold, left, right, value, roots)), start)


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """The forest for labels.quality, from at most so many labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null").where(~common.in_fold(FOLDS, HELD)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    place, whole = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), 1 << 40
    share = min(1.0, 1.2 * (rows + 1000) / max(1, known.count()))  # so that what is sorted is bounded, too
    chosen = known.where(place <= F.lit(int(whole * share))).orderBy(place, "doc_id").limit(rows).collect()  # at most `rows` pairs of numbers
    known = spark.createDataFrame([(r.doc_id, r.y) for r in chosen], T.StructType([labels.schema["doc_id"], T.StructField("y", T.IntegerType())]))
    schema = T.StructType([*common.with_doc_id(docs, ("x", T.ArrayType(T.DoubleType()))).fields, T.StructField("y", T.IntegerType())])
    out = common.arrow_schema(schema)

    def run(batches):
        for batch in common.slices(batches):
            x = [statistics(t) for t in common.text_bytes(batch.column(1))]
            yield common.typed({"doc_id": batch.column(0), "x": x, "y": batch.column(2)}, out)

    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `rows` pairs at most
    found = joined.mapInArrow(run, schema).groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(NAMES))
    return fit(x, found["y"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= cut)."""
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def work(texts):
        score = forest.value.score(_matrix(texts))
        return [pa.array(score), pa.array((score >= cut).astype(np.int32))]

    scored = common.map_texts(docs, work, [("score", T.DoubleType()), ("predicted", T.IntegerType())])
    return scored.select("doc_id", common.in_fold(FOLDS, HELD).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, that score at least cut."""
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    return common.keep_rows(docs, lambda texts: (forest.value.score(_matrix(texts)) >= cut).tolist())
