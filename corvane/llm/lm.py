"""Language-model scoring by a Brown class-based bigram model.

A token's probability is that of its class after the class before it, times that of the word in
its class. The HEAD most frequent words are put into CLASSES classes by exchange: a word
moves to the class that raises the likelihood of the training bigrams most, word by word, until
a sweep moves none. Then all words of the top tier are exchanged together, in rounds: every word
is weighed against every class by its counts of neighbours' classes, from all training texts, and
moves where the likelihood gains most; a word that isn't of the head starts from the class of its
shape. Words that move at once may spoil each other's gains, so that after the first round half of
the words move, in turn by number, if the likelihood of the whole table, counted anew, rises, else an
eighth; rounds end when neither gains more than LEAST of what classes say about their followers. Words outside the top tier, and they
alone, fall into classes by their shape (last character, length, letters beyond ASCII). Class
transitions are smoothed with the classes' own frequencies, words of shape classes by absolute
discounting, whose share goes to one unknown word per class.

Counts cover all training documents (crc32(doc_id as text) mod 7 is not 2): words are counted in
each task, then summed by word. The texts are then read once more, for pairs of neighbouring words
by number, which are counted in each task and written without a shuffle, in blocks; every later table
comes from those. Bigrams of classes are dense tables of a fixed size in each task, summed likewise;
neighbour counts are one table of top words by classes in each task (at most 150 MB), which leaves it in
blocks of _PLACED words, and the words of a block are placed where its counts meet. What is broadcast has a fixed bound: TOP words of at most
TOP_BYTES bytes with their counts, their classes, and class tables. The exact way for all other words is a join:
each document lists its distinct rare words with multiplicity, they meet the counts by word, and
sums return by document. A word outside the top has a bounded share of all tokens, or is very
long; such a key is left to skew splitting.

Cases: a null or wordless text is its end alone; a null id is in training; repeated rows each
count and get equal scores; without training documents every count is zero and the model is one
unknown word in each class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

FOLDS, HELD = 7, 2
TOP, TOP_BYTES = 200_000, 64
HEAD, CLASSES = 800, 60
#: Words that get a class by their neighbours: the whole top tier, or at most so many.
CLUSTERED: int | None = None
PRIOR, DISCOUNT = 20.0, 0.75
#: Words that a task counts before it hands its counts on.
_HELD_WORDS = 200_000
#: Rounds end when the likelihood rises by less than this share of the information between neighbouring classes.
LEAST = 0.005
#: Neighbour pairs that a task holds before it counts them and hands the counts on, rows handed on at a time, and words placed at a time.
_HELD_PAIRS, _ROWS, _PLACED = 4_000_000, 500_000, 512
END = b""

_ENDS = {ord(c): k for k, c in enumerate(".,!%*$&#")}
SHAPES = 2 * (len(_ENDS) + 5)


def words_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    out = text.lower().split() if text else []
    out.append(END)
    return out


def shape(word: bytes) -> int:
    k = _ENDS.get(word[-1])
    if k is None:
        k = len(_ENDS) + (0 if word[-1] < 58 else 1 + min(3, len(word) // 5))
    return k if word.isascii() else k + SHAPES // 2


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, shape, n) over all texts, ends as the empty word with shape -1."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            words = list(counts)
            got = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([shape(w) if w else -1 for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "shape", "n"],
            )
            counts.clear()
            return got

        for batch in common.slices(batches):
            for text in common.text_bytes(batch.column(0)):
                counts.update(words_of(text))
            if len(counts) > _HELD_WORDS:
                yield out()
        if counts:
            yield out()

    return texts.select("text").mapInArrow(run, "word binary, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


class Units:
    """Top words by number, and the unit of each: its own for head words, then the end and shapes;
    once classes are learnt, a unit is a class."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.words, self.counts = words, counts  # by falling count; the end is not among them
        self.clustered = len(words) if CLUSTERED is None else min(CLUSTERED, len(words))
        self.head = min(HEAD, self.clustered)
        self._place(np.arange(self.head), self.head)

    def _place(self, placed: np.ndarray, end: int) -> None:
        self.placed, self.end = placed, end  # units of the first words; the unit of ends, before those of shapes
        self.size = end + 1 + SHAPES
        self.numbers: dict[bytes, int] | None = None

    def learnt(self, classes: np.ndarray, k: int) -> Units:
        """The same words with the classes (below k) of the clustered ones as units."""
        out = Units(self.words, self.counts)
        out.clustered = len(classes)
        out._place(classes, k)
        return out

    @property
    def numbers_in_all(self) -> int:
        """Numbers of top words, the end and shapes."""
        return len(self.words) + 1 + SHAPES

    def __getstate__(self):
        return self.__dict__ | {"numbers": None}

    def ready(self) -> dict[bytes, int]:
        """Unit numbers by word: top words first, then the end."""
        if self.numbers is None:
            self.numbers = {w: k for k, w in enumerate(self.words)} | {END: len(self.words)}
            shapes = [self.end + 1 + shape(w) for w in self.words[len(self.placed) :]]
            self.unit = np.array([*self.placed.tolist(), *shapes, self.end, *range(self.end + 1, self.size)], np.int64)
        return self.numbers

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers (-1: rare), units and the rare words, in order."""
        get = self.ready().get
        number = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        unit = self.unit[number]
        away = np.flatnonzero(number < 0)
        rare = [words[k] for k in away.tolist()]
        if rare:
            unit[away] = np.fromiter(map(shape, rare), np.int64, len(rare)) + (self.end + 1)
        return number, unit, rare


def _packed(x: np.ndarray) -> bytes:
    """32-bit integers as one value: the planner's rows cost more than the numbers in them."""
    return pa.compress(np.ascontiguousarray(x, np.int32).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * size, "zstd", asbytes=True), np.int32)


def pair_blocks(texts: DataFrame, units) -> DataFrame:
    """(size, u, v, n), packed, v as differences: how often word v follows word u, by number, as often as tasks have counted them;
    a text follows an end. Numbers are those of the top words, then the end, then the shapes of rare words."""

    def run(batches):
        known = units.value
        keys, held = [], 0

        def out():
            at, n = np.unique(np.concatenate(keys), return_counts=True)
            keys.clear()
            for a in range(0, len(at), _ROWS):
                u, v = np.divmod(at[a : a + _ROWS], known.numbers_in_all)
                block = [_packed(u), _packed(np.diff(v, prepend=0)), _packed(n[a : a + _ROWS])]
                yield pa.RecordBatch.from_arrays([pa.array([len(u)], pa.int32()), *(pa.array([x], pa.binary()) for x in block)], names=["size", "u", "v", "n"])

        for batch in common.slices(batches):
            for text in common.text_bytes(batch.column(0)):
                number, unit, _ = known.of(words_of(text))
                number = np.where(number < 0, unit - known.end + len(known.words), number)
                keys.append(np.r_[len(known.words), number[:-1]] * known.numbers_in_all + number)
                held += len(number)
            if held > _HELD_PAIRS:
                yield from out()
                held = 0
        if keys:
            yield from out()

    return texts.select("text").mapInArrow(run, "size int, u binary, v binary, n binary")


def _pairs_of(batches) -> Iterator[list[np.ndarray]]:
    """u, v and n of rows of pairs, or of blocks of them."""
    for batch in batches:
        if batch.schema.names[0] != "size":
            yield [c.to_numpy() for c in batch.columns]
            continue
        for size, u, v, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield [_unpacked(u, size), np.cumsum(_unpacked(v, size), dtype=np.int32), _unpacked(n, size)]


def word_pairs(texts: DataFrame, units) -> DataFrame:
    """(u, v, n): the pairs of pair_blocks() as rows."""

    def run(batches):
        for u, v, n in _pairs_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], names=["u", "v", "n"])

    return pair_blocks(texts, units).mapInArrow(run, "u int, v int, n int")


def bigram_table(pairs: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often class v follows class u; of: class by number."""
    k = int(of.max()) + 1

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for u, v, n in _pairs_of(batches):
            total += np.bincount(of[u] * k + of[v], n, k * k).astype(np.int64)  # exact below 2^53
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array((at // k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(total[at])], names=["u", "v", "n"])

    return _dense(pairs.mapInArrow(run, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n")), k)


def neighbours(pairs: DataFrame, of: np.ndarray, clustered: int) -> DataFrame:
    """(part, size, at, n) of each task, packed: how often a clustered word, by number, follows a class (key: the class), stands
    before it (key: the number of classes and the class) or follows itself (key: twice the number). A part holds _PLACED words;
    at is the place of word and key in it, as differences."""

    def run(batches):
        k = int(of.max()) + 1
        width = 2 * k + 1
        total = np.zeros(clustered * width, np.int32)  # a task's pairs are fewer than 2^31
        for u, v, n in _pairs_of(batches):
            u, v = u.astype(np.int64), v.astype(np.int64)
            for word, key in ((v, of[u]), (u, k + of[v]), (np.where(u == v, u, clustered), 2 * k)):
                inside = word < clustered
                np.add.at(total, (word * width + key)[inside], n[inside])
        found = np.flatnonzero(total)
        ends = np.searchsorted(found, np.arange(0, clustered + _PLACED, _PLACED) * width).tolist()
        for part, (a, b) in enumerate(itertools.pairwise(ends)):
            if a < b:
                block = [_packed(np.diff(found[a:b] - part * _PLACED * width, prepend=0)), _packed(total[found[a:b]])]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b - a], pa.int32()), *(pa.array([x], pa.binary()) for x in block)], names=["part", "size", "at", "n"])

    return pairs.mapInArrow(run, "part int, size int, at binary, n binary")


def best_classes(starts: np.ndarray, keys: np.ndarray, counts: np.ndarray, table: np.ndarray, classes: int, own: np.ndarray | None = None) -> np.ndarray:
    """For each word, the class of the first `classes` whose bigram likelihood gains most if the
    word joins it. Neighbour counts of a word begin at starts; keys are as of neighbours(). own: the
    class that each word leaves, in which the table counts it; a word stays if no class is better."""
    k, words = len(table), len(starts)
    inside = np.searchsorted(starts, np.arange(len(keys)), "right") - 1
    n, itself = counts.astype(np.float64), np.zeros(words)
    if own is not None:
        at = keys == 2 * k
        itself[inside[at]] = n[at]
    near = np.zeros((words, 2 * k + 1))
    near[inside, keys] = n
    before, after = near[:, :k], near[:, k : 2 * k]
    if own is not None:  # the word's own pairs are with no class, wherever it goes
        before[np.arange(words), own] -= itself
        after[np.arange(words), own] -= itself
    word, key = np.nonzero(near[:, : 2 * k])
    n, late, side = near[word, key], key >= k, key % k
    at = np.concatenate([table[:, :classes], table[:classes].T])[key]  # what a class has with each neighbour's class
    diag = np.tile(table[range(classes), range(classes)], (words, 1))
    rows, columns = (np.tile(t[:classes], (words, 1)) for t in (table.sum(axis=1), table.sum(axis=0)))
    times = before.sum(axis=1) + itself  # followers are as many as predecessors
    if own is not None:  # the table without the word
        leaves = own[word]
        mine = np.flatnonzero(leaves == side)
        other = np.where(late[mine, None], before[word[mine], :classes], after[word[mine], :classes])
        at[mine] -= other
        low = np.flatnonzero(leaves < classes)
        at[low, leaves[low]] -= n[low]
        low = np.flatnonzero(own < classes)
        a = own[low]
        diag[low, a] -= before[low, a] + after[low, a] + itself[low]
        rows[low, a] -= times[low]
        columns[low, a] -= times[low]
        np.maximum(at, 0, out=at)  # entries of a word's class with itself, which diag holds
    gains = _f(at + n[:, None]) - _f(at)
    low = np.flatnonzero(side < classes)
    gains[low, side[low]] = 0
    gain = np.zeros((words, classes))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    if len(first):
        gain[word[first]] = np.add.reduceat(gains, first)
    gain += _f(diag + before[:, :classes] + after[:, :classes] + itself[:, None]) - _f(diag)
    for totals in (rows, columns):
        gain -= _f(totals + times[:, None]) - _f(totals)
    best = gain.argmax(axis=1)
    if own is None:
        return best
    stays = np.flatnonzero(own < classes)
    least = 1e-9 + 1e-12 * table.sum()  # what rounding may feign is no gain
    stays = stays[gain[stays, own[stays]] + least >= gain[stays, best[stays]]]
    best[stays] = own[stays]
    return best


def place(near: DataFrame, table: np.ndarray, classes: int, of: np.ndarray) -> DataFrame:
    """(word, class) of each word in near, as neighbours() gives it; of: the class in which it is, by number."""

    def run(blocks: pa.Table) -> pa.Table:
        width = 2 * len(table) + 1
        total = np.zeros(_PLACED * width, np.int64)
        part, size, at, n = (blocks.column(c).to_pylist() for c in ("part", "size", "at", "n"))  # one block of each task
        for k, places, times in zip(size, at, n, strict=True):
            total[np.cumsum(_unpacked(places, k))] += _unpacked(times, k)  # places of a block differ
        found = np.flatnonzero(total)
        inside, keys = np.divmod(found, width)
        words, starts = np.unique(inside, return_index=True)
        words += part[0] * _PLACED
        best = best_classes(starts, keys, total[found], table, classes, of[words])
        return pa.table([pa.array(words.astype(np.int32)), pa.array(best.astype(np.int32))], names=["word", "class"])

    return near.groupBy("part").applyInArrow(run, "word int, class int")


def information(table: np.ndarray) -> float:
    """What the likelihood of the bigrams gains by the classes before, in nats; it rises as they do better."""
    total = table.sum()
    return _f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum() + float(_f(total))


def exchange_rounds(pairs: DataFrame, of: np.ndarray, clustered: int, classes: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes by number with all words below `clustered` exchanged, their bigrams, and the information
    at the start and after each round."""
    table = bigram_table(pairs, of)
    known, moved = [information(table)], True
    while moved:
        found = place(neighbours(pairs, of, clustered), table, classes, of).toArrow()  # one row for each clustered word
        word, to = found.column("word").to_numpy(), found.column("class").to_numpy()
        moved = False
        for parts in (2, 8) if len(known) > 1 else (1,):
            new, now = of.copy(), word % parts == len(known) % parts
            new[word[now]] = to[now]
            counted = bigram_table(pairs, new)
            # the first round gives every word a class; later ones must gain
            if len(known) == 1 or information(counted) - known[-1] > LEAST * abs(known[-1]):
                of, table, moved = new, counted, True
                known.append(information(table))
                break
    return of, table, known


def _f(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, clustered: int, classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """The class of each unit: the first `clustered` units move among the first `classes` classes,
    every other unit is a class of its own. Sweeps go on until none moves, or for so many."""
    size = len(bigrams)
    classes = min(classes, clustered)
    of = np.r_[np.arange(clustered) % max(1, classes), classes + np.arange(size - clustered)].astype(np.int64)
    k = classes + size - clustered
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    n = bigrams.astype(np.float64)
    table = member.T @ n @ member
    to_class, from_class = n @ member, member.T @ n  # of each unit

    f, least = _f, 1e-9 + 1e-12 * n.sum()  # what rounding may feign is no gain
    for _ in itertools.count() if sweeps is None else range(sweeps):
        moved = 0
        for w in range(clustered):
            a, own = of[w], n[w, w]
            out, into = to_class[w].copy(), from_class[:, w].copy()
            out[a] -= own
            into[a] -= own
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= own
            t, d = table[:classes], np.arange(classes)
            diag = table[d, d]
            gain = (f(t + out) - f(t)).sum(axis=1) + (f(table[:, :classes] + into[:, None]) - f(table[:, :classes])).sum(axis=0)
            gain += f(diag + out[d] + into[d] + own) + f(diag) - f(diag + out[d]) - f(diag + into[d])
            # what precedes and follows w stays in the other classes' totals, wherever w goes
            rows, columns = (table.sum(axis=1) + into)[:classes], (table.sum(axis=0) + out)[:classes]
            gain -= f(rows + out.sum() + own) - f(rows) + f(columns + into.sum() + own) - f(columns)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + least:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                to_class[:, a] -= n[:, w]
                to_class[:, b] += n[:, w]
                from_class[a] -= n[w]
                from_class[b] += n[w]
        if not moved:
            break
    return of


class Model:
    """Log10 tables: transitions by class, words of the top tier, and totals for the others."""

    def __init__(self, units: Units, of: np.ndarray, bigrams: np.ndarray, shape_tokens: np.ndarray, shape_types: np.ndarray, total: int, types: int, ends: int):
        k = int(of.max()) + 1
        member = np.zeros((len(of), k))
        member[np.arange(len(of)), of] = 1
        table = member.T @ bigrams @ member
        share = (table.sum(axis=0) + 1) / (table.sum() + k)
        self.transition = np.log10((table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR))
        self.of, self.known_end = of, ends > 0
        inside = of[units.placed[: units.clustered]]
        mass = np.bincount(inside, units.counts[: units.clustered], minlength=k)
        shapes = np.array([shape(w) for w in units.words[units.clustered :]], np.int64)
        self.emission = np.zeros(len(units.words) + 1)
        self.emission[: units.clustered] = np.log10(units.counts[: units.clustered] / mass[inside])
        self.emission[units.clustered : -1] = np.log10((units.counts[units.clustered :] - DISCOUNT) / (shape_tokens[shapes] + 1))
        self.total, self.types = total, types
        self.base = np.log10((np.r_[units.counts, ends] + 1) / (total + types + 1))
        self.shape_tokens, self.shape_types = shape_tokens, shape_types


def _top(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, TOP at most, by falling count."""
    words = counts.where((F.col("shape") >= 0) & (F.octet_length("word") <= TOP_BYTES))
    found = sorted((-r["n"], bytes(r["word"])) for r in common.most_frequent(words.select("word", "n"), TOP))
    return [w for _, w in found], np.array([-n for n, _ in found], np.float64)


def _dense(pairs: DataFrame, size: int) -> np.ndarray:
    found, out = pairs.toArrow(), np.zeros((size, size))  # at most size * size rows, a fixed number
    out[found.column("u").to_numpy(), found.column("v").to_numpy()] = found.column("n").to_numpy()
    return out


def fit(docs: DataFrame):
    """Broadcast units and model, and the written word counts, from the training rows of docs."""
    spark = docs.sparkSession
    texts = docs.where(~common.in_fold(FOLDS, HELD)).select("text")
    counts = common.written(word_counts(texts), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("shape") < 0, F.col("n"))), F.lit(0))).first()
    units = Units(*_top(counts))
    shared = spark.sparkContext.broadcast(units)
    pairs = common.written(pair_blocks(texts, shared), "pairs")
    units.ready()
    bigrams = bigram_table(pairs, units.unit)
    of = exchange(bigrams, units.head, CLASSES)
    if units.head < units.clustered:
        classes = min(CLASSES, units.head)
        joined, bigrams, _ = exchange_rounds(pairs, of[units.unit], units.clustered, classes)
        units = units.learnt(joined[: units.clustered], classes)
        shared.unpersist()
        shared = spark.sparkContext.broadcast(units)
        of = np.arange(units.size)
    common.drop(pairs)
    by_shape = counts.where("shape >= 0").groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # SHAPES rows at most
    tokens, types = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in by_shape:
        tokens[r["shape"]], types[r["shape"]] = r["n"], r["types"]
    for w, n in zip(units.words[: units.clustered], units.counts, strict=False):
        tokens[shape(w)] -= n
        types[shape(w)] -= 1
    model = Model(units, of, bigrams, tokens, types, int(sums[0]), int(sums[1]), int(sums[2]))
    return shared, spark.sparkContext.broadcast(model), model, counts


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, classes being learnt from docs."""
    units, shared, model, counts = fit(docs)
    rare_type = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("shape", T.IntegerType()), T.StructField("times", T.IntegerType())]))
    fields = [("h", T.LongType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("model", T.DoubleType()), ("rare", rare_type)]
    schema = common.with_doc_id(docs, *fields)
    out = common.arrow_schema(schema)

    def run(batches):
        known, m = units.value, shared.value
        for batch in common.slices(batches):
            rows = []
            for text in common.text_bytes(batch.column(1)):
                words = words_of(text)
                number, unit, rare = known.of(words)
                of = m.of[unit]
                top = number[number >= 0]
                moved = m.transition[np.r_[m.of[known.end], of[:-1]], of].sum()
                seen = len(top) - (0 if m.known_end else 1)
                listed = [{"word": w, "shape": shape(w), "times": n} for w, n in Counter(rare).items()]
                rows.append((len(words), seen, float(m.base[top].sum()), float(moved + m.emission[top].sum()), listed))
            columns = list(zip(*rows, strict=True))
            yield common.typed(dict(zip(out.names, [batch.column(0), batch.column(2), *map(list, columns)], strict=True)), out)

    found = docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("h")).mapInArrow(run, schema)
    found = common.written(found, "scored")
    listed = found.where(F.size("rare") > 0).select("doc_id", "h", "rare").dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.explode("rare").alias("r")).select("doc_id", "h", "r.*")
    met = listed.join(counts.select("word", "n"), "word", "left")
    tokens, types = (F.array(*[F.lit(float(x)) for x in a]) for a in (model.shape_tokens, model.shape_types))
    n, times = F.coalesce("n", F.lit(0)), F.col("times")
    at = lambda a: F.get(a, F.col("shape"))
    weight = F.when(n > 0, n - DISCOUNT).otherwise(DISCOUNT * at(types) + 1)
    rest = met.groupBy("doc_id", "h").agg(
        F.sum(F.when(n > 0, times).otherwise(0)).alias("more_known"),
        F.sum(times * F.log10((n + 1) / F.lit(float(model.total + model.types + 1)))).alias("more_base"),
        F.sum(times * F.log10(weight / (at(tokens) + 1))).alias("more_model"),
    ).withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    joined = found.join(rest, found["doc_id"].eqNullSafe(rest["__id"]) & found["h"].eqNullSafe(rest["__h"]), "left")
    both = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return joined.select(
        "doc_id", common.in_fold(FOLDS, HELD).alias("held_out"), "n_tokens", both("known", "more_known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        both("base", "more_base").alias("base_score"), both("model", "more_model").alias("score"),
    )
