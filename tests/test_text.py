import hashlib
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import lexical, text, values
from corvane.operators import chunking


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


def test_clean_text(spark):
    assert one(spark, "  a \t b\n\n\n\nc \n d  ", text.clean_text) == "a b\n\nc\nd"
    assert one(spark, "a\n \n \nb", text.clean_text) == "a\n\n\nb"
    assert one(spark, " 　\n", text.clean_text) == ""
    assert one(spark, None, text.clean_text) is None


def test_paragraphs_and_packing(spark):
    split = lambda c: text.split_paragraphs(c)
    assert one(spark, "a\n\n \n\nb ", split) == ["a", "b"]
    pack = lambda c: text.pack_paragraphs(c, 100)
    a, b, big = "a" * 60, "b" * 60, "c" * 150
    assert one(spark, [a, b], pack, "array<string>") == [a, b]
    assert one(spark, ["a" * 50, "b" * 50], pack, "array<string>") == ["a" * 50 + "\n\n" + "b" * 50]
    assert one(spark, [a, big, "d"], pack, "array<string>") == [a, big, "d"]
    assert one(spark, [], pack, "array<string>") == []


@pytest.mark.parametrize("n", [0, 1, 499, 500, 501, 900, 901, 1300, 1301, 2199])
def test_windows(spark, n):
    words = "".join(chr(97 + i % 26) for i in range(n))
    got = one(spark, words, text.child_windows)
    assert len(got) == (0 if n == 0 else 1 if n <= 500 else 1 + math.ceil((n - 500) / 400))
    assert all(len(w) <= 500 for w in got)
    assert "".join(w if i == 0 else w[100:] for i, w in enumerate(got)) == words


def test_ids_and_estimates(spark):
    row = spark.range(1).select(
        text.parent_id(F.lit("Boe"), F.lit("Wiki"), F.lit(7)).alias("p"), text.child_id(F.lit("Boe"), F.lit("Wiki"), F.lit(1234)).alias("c"),
        text.document_id(F.lit("/x/data/raw/wiki/A.txt")).alias("d"), text.document_id(F.lit("/elsewhere/A.txt")).alias("e"),
        text.token_estimate(F.lit("abcde")).alias("t"), text.token_estimate(F.lit(None).cast("string")).alias("z"),
    ).first()
    assert (row.p, row.c, row.t, row.z) == ("boe_wiki_p007", "boe_wiki_c1234", 2, 0)
    assert row.d == hashlib.sha256(b"wiki/A.txt").hexdigest()[:16] and row.e == hashlib.sha256(b"A.txt").hexdigest()[:16]


def test_chunks_number_over_the_document(spark):
    docs = spark.createDataFrame([("N", "wiki", "data/raw/wiki/N.txt", "a" * 1500 + "\n\n" + "b" * 1500), ("E", "pdf", "p", ""), ("Z", "pdf", "q", None)], "name string, source string, path string, text string")
    rows = chunking.chunks(docs).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == [f"n_wiki_c{i:03d}" for i in range(8)]
    assert [r.parent_id for r in rows] == ["n_wiki_p000"] * 4 + ["n_wiki_p001"] * 4
    assert chunking.parents(docs).count() == 2
    assert chunking.chunks(docs.limit(0)).count() == 0


def test_question(spark):
    def check(t):
        return one(spark, t, text.question)

    assert check("igno\u200bre\u202e this")[0] == "ignore this"
    assert check("  ")[1] == "empty" and check(None)[1] == "missing" and check("a" * 1001)[1] == "too long"
    assert check("ｆｕｌｌ")[0] == "full"
    assert check("a\u200db")[0] == "ab" and check("न\u200dम")[0] == "न\u200dम"


def test_question_in_one_pass(spark):
    """What the column expressions give, on odd texts; joiners beside white space go, and long texts pass no pattern of Java's."""
    rng, signs = random.Random(3), "aZ \u00e9e\u0301\u200c\u200d\u200b\u202e\u2069\x01\x0b\x1c\x7f\x85\xa0\u2003\u2028\u3000\ufb01\n\t\U0001d400\U0001f600\ufeff\u0915\u094d"
    texts = [None, "", "\u0915 \u200d \u0915", *("".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(3000))]
    rows = spark.createDataFrame([(t, unicodedata.normalize("NFKC", t) if t else t) for t in texts], "t string, n string")
    found = rows.select(text.question(F.col("t"))["text"].alias("q"), text.strip(text.without_controls(F.col("n"))).alias("c"))
    assert all(r.q == r.c for r in found.collect())
    assert one(spark, "\u0915 \u200d \u0915", text.question)[0] == "\u0915  \u0915"
    assert "regexp_replace" not in rows.select(text.question(F.col("t")))._jdf.queryExecution().toString()


def test_escape_and_windows(spark):
    assert one(spark, "<a href=\"x\">'&'</a>", text.html_escape) == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"
    for n, k in ((1020, 4), (511, 2), (529, 2), (0, 0), (19, 0), (20, 1)):
        assert len(one(spark, n, chunking.token_windows, "int")) == k, n


def test_stems():
    for word, stem in (("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("adjustment", "adjust"), ("controlling", "control"), ("happy", "happi"), ("sky", "sky"), ("generalization", "gener"), ("oscillators", "oscil")):
        assert lexical.porter_stem(word) == stem
    assert lexical.query_terms("The flights", stem=True) == ["flight"] and lexical.query_terms("the of", stem=True) == []


def test_values(spark):
    row = spark.range(1).select(
        values.to_int(F.lit("3.9")).alias("a"), values.to_int(F.lit("inf")).alias("b"), values.to_int(F.lit("x")).alias("c"), values.to_date(F.lit("2024-02-30")).alias("d"),
        values.to_date(F.lit("2024-02-03T10:00:00Z")).cast("string").alias("e"), values.to_time(F.lit("9:05Z")).alias("f"), values.total_injuries(F.lit(None).cast("int"), F.lit(0), F.lit(None).cast("int")).alias("g"),
        values.years_before(F.lit("2024-02-29").cast("date"), 1).cast("string").alias("h"), values.to_timestamp(F.lit("2024-01-02")).cast("string").alias("i"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h, row.i) == (3, None, None, None, "2024-02-03", "9:05", None, "2023-02-28", "2024-01-02 00:00:00")
