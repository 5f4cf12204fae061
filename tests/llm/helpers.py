"""Small tables with every odd case, and plain versions of what operators compute."""

import random
import re

from pyspark.sql import functions as F

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return SPACES.findall(lower(text or ""))


def corpus(seed=0, n=60, long=3000):
    """Ids and texts: prose, copies, near copies, empty, null, blank, very long, odd characters."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["th", "er", "in", "an", "é", "ou", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", "", "", ".", ","]) for _ in range(k))
    rows = [(i, prose(rng.randint(5, 120)).replace(". ", ".\n", 3)) for i in range(n)]
    base = prose(200)
    rows += [(100 + i, base) for i in range(5)]
    for i in range(8):
        parts = base.split(" ")
        parts[20 * i] = "changed"
        rows.append((120 + i, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, prose(long)), (204, "one"), (205, "one two"), (206, "a  b\x0bc d e \U0001f600 \x00 f"), (207, "x" * 5000), (208, "ab " * 700)]
    return rows


#: Names that operators give to results or columns on the way.
CLASHING = ("h", "g", "fp", "root", "score", "start", "length", "n_bytes", "n_tokens", "spans", "strong", "weak", "word", "n", "m", "s", "open", "distance", "level", "x0", "y", "component_id", "sequence_id")


def docs(spark, rows, extra=True):
    """The rows as documents, with columns whose names clash with results."""
    full = [(i, t, ["en", "fr", None][(i or 0) % 3], ["s0", None][(i or 0) % 2], len(t or ""), 7, "x") for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string")
    clashing = {n: F.lit(f"mine {n}") for n in CLASHING} if extra else {}
    return df.withColumns(clashing).repartition(3) if extra else df.drop("n_words", "kept")
