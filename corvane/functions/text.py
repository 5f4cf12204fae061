"""Text functions as Column expressions: cleaning, splitting, packing, windows, ids, estimates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunk sizes in characters: parent target, child window, shared by neighbouring windows.
PARENT_CHARS, CHILD_CHARS, OVERLAP_CHARS = 2000, 500, 100
QUESTION_CHARS = 1000
#: White space as Unicode has it, in a Java class.
_SPACE = r"[\s\x0B\x1C-\x1F\u0085\p{Z}]"
#: Control, zero-width and direction marks, for Java and Python.
_MARKS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u200b\u200e\u200f\u2028\u2029\u202a-\u202e\u2066-\u2069]"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def clean_text(text: Column) -> Column:
    """Stripped; three and more newlines are two; runs of blanks are one; no blanks around newlines."""
    out = F.regexp_replace(strip(text), r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.regexp_replace(out, r" ?\n ?", "\n")


def split_paragraphs(text: Column, mark: str = "\n\n") -> Column:
    """The stripped, non-empty pieces between marks."""
    return F.filter(F.transform(F.split(text, mark), strip), lambda p: F.length(p) > 0)


def pack_paragraphs(paragraphs: Column, target: int = PARENT_CHARS, mark: str = "\n\n") -> Column:
    """Paragraphs joined in order up to the target; marks don't count, a longer paragraph stands alone.

    The buffer is reset by what it holds, so this is a fold in one row, not a window frame.
    """
    nothing = F.array().cast("array<string>")
    start = F.struct(nothing.alias("done"), nothing.alias("held"), F.lit(0).alias("size"))

    def step(s, p):
        full = (F.size(s["held"]) > 0) & (s["size"] + F.length(p) > target)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.array_join(s["held"], mark)))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(s["held"], F.array(p))).alias("held"),
            F.when(full, F.length(p)).otherwise(s["size"] + F.length(p)).alias("size"),
        )

    return F.aggregate(paragraphs, start, step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["done"], F.array(F.array_join(s["held"], mark)))).otherwise(s["done"]))


def child_windows(text: Column, size: int = CHILD_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Overlapping windows up to the first that reaches the end; none for an empty text."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    kept = F.filter(starts, lambda s: (n > 0) & ((s == 0) | (s + overlap < n)))
    return F.transform(kept, lambda s: F.substring(text, s + 1, F.lit(size)))


def parent_id(name: Column, source: Column, number: Column) -> Column:
    return F.format_string("%s_%s_p%03d", F.lower(name), F.lower(source), number)


def child_id(name: Column, source: Column, number: Column) -> Column:
    return F.format_string("%s_%s_c%03d", F.lower(name), F.lower(source), number)


def document_id(path: Column, root: str = "data/raw/") -> Column:
    """First 16 hex digits of the path's hash below root; of the file name where it lies elsewhere."""
    inside = F.when(F.contains(path, F.lit(root)), F.substring_index(path, root, -1)).otherwise(F.substring_index(path, "/", -1))
    return F.substring(F.sha2(inside, 256), 1, 16)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; zero for null."""
    return F.coalesce(F.floor((F.length(text) + 3) / 4), F.lit(0)).cast("long")


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility form without combining marks, white space collapsed, case folded; null is empty."""

    def one(t):
        plain = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c))
        return " ".join(plain.split()).casefold()

    return text.map(one)


def without_controls(text: Column) -> Column:
    """No control, zero-width or direction marks; joiners only between two visible letters beyond ASCII."""
    out = F.regexp_replace(text, _MARKS, "")
    odd = r"[[^\x00-\x7F]&&[^\s\u0085\p{Z}]]"  # an outer ^ would turn the whole class, white space too
    return F.regexp_replace(out, rf"(?<!{odd})[\u200c\u200d]|[\u200c\u200d](?!{odd})", "")


@F.pandas_udf(T.StringType())
def cleaned(text: pd.Series) -> pd.Series:
    """strip(without_controls()) of the compatibility form, by built-in functions: they pass long texts many times faster than
    patterns in Java do."""
    marks, joiners = re.compile(_MARKS), re.compile(r"(?<![^\x00-\x7F\s])[\u200c\u200d]|[\u200c\u200d](?![^\x00-\x7F\s])")
    plain = dict.fromkeys(c for c in range(128) if marks.match(chr(c)))

    def one(t):
        if t is None:
            return None
        if t.isascii():
            return t.translate(plain).strip()
        out = marks.sub("", unicodedata.normalize("NFKC", t))
        return (joiners.sub("", out) if "\u200c" in out or "\u200d" in out else out).strip()

    return text.map(one)


def question(text: Column, most: int = QUESTION_CHARS) -> Column:
    """A struct of the cleaned question and what is wrong with it (null, 'missing', 'empty' or 'too long')."""
    clean = cleaned(text)
    wrong = F.when(text.isNull(), "missing").when(F.length(clean) == 0, "empty").when(F.length(clean) > most, "too long")
    return F.struct(clean.alias("text"), wrong.alias("error"))


def prompt_block(tag: str, fields: dict[str, Column]) -> Column:
    """One block of a prompt: escaped fields as attributes-by-line between tags."""
    lines = [F.concat(F.lit(f"{name}: "), html_escape(F.coalesce(c.cast("string"), F.lit("")))) for name, c in fields.items()]
    return F.concat(F.lit(f"<{tag}>\n"), F.concat_ws("\n", *lines), F.lit(f"\n</{tag}>"))
