"""Sum-of-squares online packing of token sequences into windows.

Each document is an item of its ids and an end id. Items longer than a window first fill whole
windows. The rest goes to the fill level that leaves the smallest sum of squared counts of
partly filled windows by level: with counts N, moving a window from level h to h + n changes the
sum by 2 (N[h+n] - N[h]) + 2, or 1 - 2 N[h] if the window becomes full, and opening one by
2 N[n] + 1. The counts stand in an array, so one vectorised look decides each placement.

Every task packs what it reads, online; only partly filled windows are held, at most OPEN of
them. At the end of a task, or when more are open, windows are finished: the emptiest windows'
pieces are cut to fill the fullest ones' gaps. A task's last window splits into lengths that are
powers of two, which need no padding. So documents are cut only if longer than a window or to
finish windows, and no padding is left.

Scale: map-only, no shuffle; memory is OPEN windows a task. Sequence ids carry the task's number
in their upper bits. A rerun task packs its rows anew, and whole.

Cases: a null or empty text is its end id alone; repeated rows are packed each; the id of a
document may be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm import common, tokens

WINDOW, END_ID = 2048, 1
#: Partly filled windows that a task holds at most.
OPEN = 1024
#: Rows of the result in an Arrow batch.
_ROWS = 8192


class Packer:
    """Online packing. Calls emit(sequence number, pieces) for each finished window; a piece is
    (document, start, id bytes, ids in the document)."""

    def __init__(self, emit, window: int = WINDOW, most_open: int = OPEN):
        self.emit, self.window, self.most_open = emit, window, most_open
        self.count = np.zeros(window + 1, np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = self.next = 0

    def _finish(self, pieces: list) -> None:
        self.emit(self.next, pieces)
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        """Place one document, given as 4 bytes an id."""
        total, size, at = len(ids) // 4, self.window, 0
        while total - at >= size:
            self._finish([(doc, at, ids[4 * at : 4 * (at + size)], total)])
            at += size
        if at < total or not total:
            self.place((doc, at, ids[4 * at :], total), total - at)

    def place(self, piece: tuple, n: int) -> None:
        if not n:
            return
        size, count = self.window, self.count
        # levels 1 .. size - n can take the piece; the change is halved, less one
        change = count[1 + n : size + 1] - count[1 : size - n + 1]
        change = change.astype(np.float64)
        if len(change):
            change[-1] = -count[size - n] - 0.5
            change[count[1 : size - n + 1] == 0] = np.inf
            h = int(change.argmin()) + 1
            if change[h - 1] < count[n] - 0.5 or (change[h - 1] == count[n] - 0.5 and h == size - n):
                pieces = self.levels[h].pop()
                count[h] -= 1
                pieces.append(piece)
                if h + n == size:
                    self.open -= 1
                    self._finish(pieces)
                else:
                    self.levels[h + n].append(pieces)
                    count[h + n] += 1
                return
        self.levels[n].append([piece])
        count[n] += 1
        self.open += 1
        if self.open > self.most_open:
            self.drain(self.most_open // 2)

    def drain(self, leave: int = 0) -> None:
        """Fill the fullest open windows with what the emptiest hold, cut where needed, until so many are open."""
        windows = [(h, p) for h in range(1, self.window) for p in self.levels[h]]  # by fill
        self.levels = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.open = 0
        first, last = 0, len(windows) - 1
        while last - first + 1 > max(leave, 1):
            fill, pieces = windows[last]
            last -= 1
            gap = self.window - fill
            while gap and first <= last:
                h, source = windows[first]
                doc, start, ids, total = source.pop()
                n = len(ids) // 4
                take = min(n, gap)
                pieces.append((doc, start, ids[: 4 * take], total))
                gap -= take
                if take < n:
                    source.append((doc, start + take, ids[4 * take :], total))
                windows[first] = (h - take, source)
                if h == take:
                    first += 1
            if gap:
                last += 1
                windows[last] = (self.window - gap, pieces)
                break
            self._finish(pieces)
        for h, pieces in windows[first : last + 1]:
            self.levels[h].append(pieces)
            self.count[h] += 1
            self.open += 1

    def close(self) -> None:
        """Finish all windows; the last is split into powers of two."""
        self.drain()
        rest = [p for level in self.levels for pieces in level for p in pieces]
        left = sum(len(p[2]) // 4 for p in rest)
        self.levels, self.open = [[] for _ in range(self.window + 1)], 0
        self.count[:] = 0
        while left:
            room, pieces = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, total = rest.pop()
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], total))
                room -= take
                if 4 * take < len(ids):
                    rest.append((doc, start + take, ids[4 * take :], total))
            self._finish(pieces)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids."""
    path = path or tokens.default_path()
    fields = [(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = common.with_doc_id(docs, *fields, *([("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    out = common.arrow_schema(schema)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 33
        rows: list[tuple] = []

        def emit(number, pieces):
            offset = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                row = (doc, start, n, zlib.crc32(ids), total, base + number, offset)
                rows.append((*row, np.frombuffer(ids, "<u4").tolist()) if with_ids else row)
                offset += n

        def batch_of():
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
            rows.clear()
            return got

        packer = Packer(emit, window)
        for batch in common.slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, tokens.token_ids(text, path).tobytes() + end)
                if len(rows) >= _ROWS:
                    yield batch_of()
        packer.close()
        if rows:
            yield batch_of()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
