"""Token counts and ids by a two-tier lookup, without a shuffle of pre-tokens.

The pre-tokenizer of a byte-level BPE file ends every pre-token before a space that follows a
character other than white space and begins a new one there, so a text may be cut before each such
space and its pieces encoded alone; special strings hold no space and so are never cut. The
first tier is a compact table of the most frequent pieces and their lengths in tokens, broadcast
(at most TABLE_ENTRIES pieces of at most TABLE_PIECE bytes, a bound that no corpus moves). The
second is a cache in each Python worker, of bounded size, behind which stands the library.

The table is filled from a sample spread over all rows by hash, of about SAMPLE_ROWS texts of
SAMPLE_BYTES at most, whose pieces the driver counts. It decides how often a worker meets the library,
never a result: what it doesn't hold is counted behind it. Counting is one map-only pass over whole texts.

Cases: a null text counts as empty and has no tokens; rows stay as they are, repeated or not;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

LIMIT = 1024
TABLE_ENTRIES, TABLE_PIECE = 1 << 15, 40
#: Texts from which the table is filled (twice as many at most), and bytes of each at most.
SAMPLE_ROWS, SAMPLE_BYTES = 1 << 13, 1 << 14
#: Pieces in each of the two generations of a worker's cache.
CACHE_ENTRIES = 300_000
#: Characters of a piece that is kept there; longer ones are encoded each time.
CACHED_PIECE = 128

_TOKENIZERS: dict[str, object] = {}
#: Where a text may be cut: before a space, after something else than white space.
_CUT = re.compile(r"(?<=\S)(?= )")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in each process."""
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _TOKENIZERS[path] = loaded
    return _TOKENIZERS[path]


def pieces(text: str) -> list[str]:
    """The text cut before each space that follows something else than white space."""
    parts = text.split(" ")
    if "" not in parts and not any(p[-1].isspace() for p in parts):
        return parts[:1] + [" " + p for p in parts[1:]]
    return _CUT.split(text)  # linear whatever the run


class Pieces:
    """What encode gives for each piece, kept in two generations of bounded size."""

    def __init__(self, encode, entries: int = CACHE_ENTRIES):
        self.encode, self.entries, self.young, self.old = encode, entries, {}, {}

    def fill(self, wanted: list[str]) -> None:
        """Make every wanted piece present in young."""
        young, old = self.young, self.old
        missing = []
        for p in wanted:
            if p in old:
                young[p] = old[p]
            else:
                missing.append(p)
        for k in range(0, len(missing), 4096):
            part = missing[k : k + 4096]
            young.update(zip(part, self.encode(part), strict=True))

    def turn(self) -> None:
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}


def _lengths(path: str):
    return lambda part: [len(e.ids) for e in tokenizer(path).encode_batch_fast(part, add_special_tokens=False)]


#: The pattern by which a byte-level pre-tokenizer with use_regex cuts texts (fixed value).
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary file writes bytes: printable ones stand for
    themselves, the others for letters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def rank_encoder(path: str):
    """An encoder with the file's vocabulary, ids and special strings that merges by rank and
    yields arrays: the tokenizer's ids at several times its speed. Loaded once in each process."""
    key = f"ranks:{path}"
    if key not in _TOKENIZERS:
        import json

        import tiktoken

        tokenizer(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        special = {x["content"]: x["id"] for x in said["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
        _TOKENIZERS[key] = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _TOKENIZERS[key]


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of one text, special strings included, nothing added."""
    if not text:
        return np.zeros(0, "<u4")
    try:
        return _by_rank(text, path)
    except ValueError:  # a run of white space too long for the encoder
        return np.concatenate([_piece_ids(p, path) for p in pieces(text)])


def _by_rank(text: str, path: str) -> np.ndarray:
    return rank_encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def _piece_ids(piece: str, path: str) -> np.ndarray:
    try:
        return _by_rank(piece, path)
    except ValueError:
        return np.array(tokenizer(path).encode(piece, add_special_tokens=False).ids, "<u4")


_CACHES: dict = {}


def _cached(path: str) -> Pieces:
    if path not in _CACHES:
        _CACHES[path] = Pieces(_lengths(path))
    return _CACHES[path]


class Table:
    """A frozen hash table from frequent pieces to lengths: one blob, offsets and lengths."""

    def __init__(self, counts: dict[str, int], lengths: dict[str, int]):
        chosen = sorted((p for p in counts if len(p.encode()) <= TABLE_PIECE), key=lambda p: (-counts[p], p))[:TABLE_ENTRIES]
        self.blob = b"".join(p.encode() for p in chosen)
        self.ends = np.cumsum([len(p.encode()) for p in chosen], dtype=np.uint32) if chosen else np.zeros(0, np.uint32)
        self.lengths = np.array([lengths[p] for p in chosen], np.uint16)

    def lookup(self) -> dict[str, int]:
        out, a = {}, 0
        for b, n in zip(self.ends.tolist(), self.lengths.tolist(), strict=True):
            out[self.blob[a:b].decode()] = n
            a = b
        return out


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[str]:
    """About so many texts of at most `most` bytes, spread over all rows by hash."""
    share = max(1, docs.count() // rows)
    text = F.col("text").cast("string")
    picked = docs.where(F.pmod(F.xxhash64("doc_id", text), F.lit(share)) == 0).where(F.octet_length(text) <= most)
    return picked.select(text.alias("text")).limit(2 * rows).toArrow().column("text").to_pylist()


def frequent(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS) -> Table:
    """The broadcast tier: the pieces that are most frequent in a sample. Only speed depends on it."""
    counts: Counter = Counter()
    for text in sample(docs, rows):
        counts.update(p for p in pieces(text) if len(p) <= TABLE_PIECE)
    top = [p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]]
    return Table({p: counts[p] for p in top}, dict(zip(top, _lengths(path)(top), strict=True)))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = path or default_path()
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))
    key = ("table", uuid.uuid4().hex)

    def work(texts):
        if key not in _CACHES:
            for k in [k for k in _CACHES if k[0] == "table"]:
                del _CACHES[k]  # of an earlier call
            _CACHES[key] = table.value.lookup()
        first, cache, lengths = _CACHES[key], _cached(path), _lengths(path)
        n_bytes, n_tokens = [], []
        for raw in texts:
            n_bytes.append(len(raw or b""))
            cut = pieces(raw.decode("utf-8", "replace")) if raw else []
            got = list(map(first.get, cut))
            if None in got:
                rare = [p for p, g in zip(cut, got, strict=True) if g is None]
                long = [p for p in rare if len(p) > CACHED_PIECE]
                if long:
                    rare = [p for p in rare if len(p) <= CACHED_PIECE]
                more = list(map(cache.young.get, rare))
                if None in more:
                    cache.fill(list({p for p, g in zip(rare, more, strict=True) if g is None}))
                    more = list(map(cache.young.get, rare))
                n_tokens.append(sum(filter(None, got)) + sum(more) + sum(sum(lengths([p])) for p in long))
                cache.turn()
            else:
                n_tokens.append(sum(got))
        return [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])]

    return common.map_texts(docs, work, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())])
