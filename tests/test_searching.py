"""Many questions in one job against one scan a question; blocks that go unread; claims in rounds; budgets by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import indexing, merging, retrieval, searching


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["the"] * 60
    rows = [(i, i // 3, " ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) + (" rare" * (i % 7) if i % 50 == 0 else ""), [rng.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows += [(800 + i, 400 + i, rows[1][2], rows[1][3]) for i in range(40)]  # ties
    rows += [(900, None, "rare the w1", [1.0] * 6), (901, 500, None, None), (902, 501, "", [0.0] * 6), (903, 502, "rare", [1.0, 2.0]), (904, None, None, None)]
    return spark.createDataFrame(rows, "chunk_id long, parent_id long, text string, embedding array<float>").repartition(3).cache()


def asked(spark):
    rows = [(1, ["rare", "the"], [1.0, 0, 0, 0, 0, 0]), (2, ["the"], [0.0, 1, 1, 0, 0, 0]), (3, ["w1", "w2", "w3", "w1"], None), (4, [], [0.0] * 6), (5, None, [1.0, -1, 0, 0, 0, 2]), (6, ["unknown"], [1.0, 2.0]), (7, ["unknown", "rare", "w5"], [0.5, 0, 0, 0, 0, -1])]
    return spark.createDataFrame([(q, t, v and [float(x) for x in v]) for q, t, v in rows], "query int, terms array<string>, v array<double>")


@pytest.mark.parametrize("per", [4, 128])
def test_keyword_questions(spark, corpus, per):
    stats = indexing.sizes(corpus)
    blocks = searching.term_blocks(corpus, stats, per=per).cache()
    assert blocks.agg(F.sum("n")).first()[0] == indexing.postings(corpus).count()
    got = {}
    for r in searching.keyword_leg(asked(spark), blocks, stats, 10).collect():
        got.setdefault(r.query, []).append((r.rnk, r.parent_id, r.score))
    for q, terms, _ in asked(spark).collect():
        wanted = sorted(set(terms or []))
        scores = indexing.keyword_scores(indexing.postings(corpus), stats, wanted).where("parent_id is not null")
        best = scores.groupBy("parent_id").agg(F.max(F.round("score", 9)).alias("s")).orderBy(F.desc("s"), "parent_id").limit(10).collect()
        assert [(p, pytest.approx(s, abs=1e-8)) for _, p, s in sorted(got.get(q, []))] == [(r.parent_id, r.s) for r in best], q
    assert set(got) == {1, 2, 3, 7}


def test_postings_are_not_exchanged(spark, corpus):
    """Blocks are made where the children of a range meet: one exchange, by range; a child that comes twice is counted once."""
    stats = indexing.sizes(corpus)
    blocks = searching.term_blocks(corpus, stats, per=16)
    plan = blocks._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(range" in plan
    twice = searching.term_blocks(corpus.union(corpus), stats, per=16)
    told = lambda b: {(r.term, r.range): (r.n, r.top > 0) for r in b.select("term", "range", "n", "top").collect()}
    assert told(twice) == told(blocks)


def test_blocks_go_unread(spark, corpus):
    """Ranges without a rare term can't reach the k-th score; fewer than k results prune nothing."""
    stats = indexing.sizes(corpus)
    blocks = searching.term_blocks(corpus, stats, per=8).cache()
    ask = lambda terms, k: searching.blocks_read(spark.createDataFrame([(1, terms)], "query int, terms array<string>"), blocks, stats, k).first()
    few = ask(["rare", "the"], 5)
    assert 0 < few.read < 0.4 * few.blocks
    every = ask(["rare", "the"], 10_000)
    assert every.read == every.blocks == few.blocks


def test_vector_questions(spark, corpus):
    blocks = searching.vector_blocks(corpus, rows=50).cache()
    got = {}
    for r in searching.vector_leg(asked(spark), blocks, k=10, tile=2).collect():
        got.setdefault(r.query, []).append((r.rnk, r.parent_id))
    for q, _, v in asked(spark).collect():
        if v is None or len(v) != 6:
            continue
        best = corpus.where("parent_id is not null and size(embedding) = 6").groupBy("parent_id").agg(F.max(F.round(1 - retrieval.vector.cosine_distance(F.col("embedding"), v), 9)).alias("s")).where("s is not null").orderBy(F.desc("s"), "parent_id").limit(10)
        assert [p for _, p in sorted(got.get(q, []))] == [r.parent_id for r in best.collect()], q
    assert got[6] == [(1, 502)] and 3 not in got and 4 not in got


def test_vector_questions_in_cells(spark, corpus):
    kept = corpus.where("embedding is not null and parent_id is not null and size(embedding) = 6")
    cells = indexing.learn_cells(kept)
    found = searching.vector_leg(asked(spark), searching.vector_blocks(kept, cells), cells, 5)
    exact = searching.vector_leg(asked(spark), searching.vector_blocks(kept), None, 5)
    assert found.join(exact, ["query", "parent_id"]).count() >= 0.8 * exact.where("query <> 6").count()


def test_hybrid_questions(spark, corpus):
    """Fused ranks are those of the search of each question alone, with stored and scanned keyword legs."""
    stats, parents = indexing.sizes(corpus), corpus.select("parent_id", F.lit("t").alias("text")).where("parent_id % 2 = 0").distinct()
    blocks = searching.term_blocks(corpus, stats, per=16).cache()
    sound = corpus.where("size(embedding) = 6 or embedding is null")
    got = {}
    for r in searching.hybrid(asked(spark), parents, blocks, stats, searching.vector_blocks(sound), candidates=12).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.parent_id, r.vector_rank, r.keyword_rank))
    one = searching.keyword_leg(asked(spark).where("query = 7"), blocks, stats, 12).select("parent_id", "rnk")
    want = retrieval.hybrid(sound, parents, [0.5, 0.0, 0.0, 0.0, 0.0, -1.0], "", candidates=12, keyword=one).collect()
    assert got[7] == [(r.parent_id, r.vector_rank, r.keyword_rank) for r in want] and len(got[7]) == 5
    assert "CartesianProduct" not in searching.hybrid(asked(spark), parents, blocks, stats, searching.vector_blocks(sound))._jdf.queryExecution().toString()
    none = asked(spark).where("false")
    assert searching.hybrid(none, parents, blocks, stats, searching.vector_blocks(sound)).count() == 0
    assert searching.keyword_leg(asked(spark), searching.term_blocks(corpus.limit(0), stats), stats).count() == 0


def greedy(rows):
    keys, numbers, out = set(), set(), []
    for o, k, n in sorted(rows, key=lambda r: r[0]):
        said = n.upper() if n else None
        if k not in keys and (said is None or said not in numbers):
            out.append(o)
            keys.add(k)
            numbers.add(said)
    return out


def test_claims_in_rounds(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 1, rng.randint(0, 400), None]), rng.choice([None, "", f"n{rng.randint(0, 300)}", f"N{rng.randint(0, 300)}", "hot"])) for i in rng.sample(range(5000), 1200)]
    df = spark.createDataFrame(rows, "o int, case_key int, case_number string").repartition(5)
    got, rounds = merging.claims_in_rounds(df, "o")
    assert sorted(r.o for r in got.collect()) == greedy(rows) and got.columns == df.columns and 1 < rounds < 15
    parts, _ = merging.claims_in_rounds(df.withColumn("p", F.col("o") % 3), "o", partition=["p"])
    assert sorted(r.o for r in parts.collect()) == sorted(o for p in range(3) for o in greedy([r for r in rows if r[0] % 3 == p]))
    chain = [(i, i // 2, f"x{(i + 1) // 2}") for i in range(12)]  # each row is the rival of the next
    got, rounds = merging.claims_in_rounds(spark.createDataFrame(chain, "o int, case_key int, case_number string"), "o")
    assert sorted(r.o for r in got.collect()) == greedy(chain) and rounds > 3
    twice = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 1, "b")], "o int, case_key int, case_number string")
    assert [tuple(r) for r in merging.claims_in_rounds(twice, "o")[0].collect()] == [(1, 1, "a")]
    assert merging.claims_in_rounds(twice.limit(0), "o")[0].count() == 0


@pytest.mark.parametrize("most", [0, 1, 777, 10**9])
def test_budget_by_ranges(spark, most):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), "x" * rng.randint(0, 30) if i % 11 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, g string, text string").repartition(7)
    order = [F.desc_nulls_last("g"), F.col("i")]
    got = {r.i: r.running for r in retrieval.context_budget(df, order, most=most).collect()}
    want, at = {}, 0
    for i, _, t in sorted(rows, key=lambda r: (r[1] is None, -ord(r[1] or "a"), r[0])):
        at += len(t or "")
        if at <= most:
            want[i] = at
    assert got == want
    assert retrieval.context_budget(df.limit(0), order, most=most).count() == 0


def test_many_questions_in_groups(spark):
    """Groups and shares of any size give what blocks by bounds give, with ties, ids met twice, null parents and terms unknown."""
    texts = [(i, None if i % 11 == 0 else i // 3, " ".join(f"w{(i * j) % 13}" for j in range(i % 9))) for i in range(200)] + [(7, 2, "w1 w1 w2"), (500, 1, None)]
    children = spark.createDataFrame(texts, "chunk_id long, parent_id long, text string")
    stats = indexing.sizes(children)
    blocks = searching.term_blocks(children, stats, per=16).cache()
    asked = spark.createDataFrame([(i, [f"w{i}", f"w{i + 3}", "none", f"w{i}"]) for i in range(11)] + [(50, []), (51, ["none"])], "query long, terms array<string>")
    want = sorted(map(tuple, searching.keyword_leg(asked, blocks, stats, 4).collect()))
    for sizes in ((20, 3), (1000, 1000)):
        assert sorted(map(tuple, searching.keyword_leg_of_many(asked, blocks, stats, 4, children=sizes[0], share=sizes[1]).collect())) == want
    assert len(want) == 44


def test_many_questions_meet_packed_blocks(spark):
    """Blocks of ranges, in rows of few postings, give what blocks of terms give, where bounds of the first groups cut the others: with
    frequent terms summed late or early, children of one parent, and no row for each question, range or posting."""
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(3000)]
    texts = [(i, None if i % 17 == 0 else i // 3, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(900)] + [(2000 + i, 700, "w5 w6 w7") for i in range(9)] + [(3000 + i, 800 + i, "w1 w1 w2 w4") for i in range(40)]
    children = spark.createDataFrame(texts, "chunk_id long, parent_id long, text string").repartition(3)
    stats = indexing.sizes(children)
    asked = spark.createDataFrame([(i, list(set(rng.choices(words, k=12)))) for i in range(60)] + [(90, ["w1", "w2"]), (91, ["w5", "w9"])], "query long, terms array<string>")
    want = sorted(map(tuple, searching.keyword_leg(asked, searching.term_blocks(children, stats, per=16).cache(), stats, 5).collect()))
    blocks = searching.range_blocks(children, stats, per=32, pack=50).cache()
    assert blocks.count() > 100 and blocks.agg(F.max(F.size("n"))).first()[0] <= 50
    assert blocks.agg(F.sum(F.expr("aggregate(n, 0, (a, b) -> a + b)"))).first()[0] == indexing.postings(children).count()
    for most in (120, 5000):
        assert sorted(map(tuple, searching.keyword_leg_of_many(asked, blocks, stats, 5, children=most).collect())) == want
    assert len(want) == 310


def test_vectors_meet_in_groups_of_blocks(spark, corpus):
    """Blocks without cells have one cell: they are dealt, not met by it in one task, and give what one block gives."""
    one = searching.vector_leg(asked(spark), searching.vector_blocks(corpus), k=7)
    some = searching.vector_leg(asked(spark), searching.vector_blocks(corpus, rows=40), k=7, tile=3)
    assert "CoGroup" in some._jdf.queryExecution().toString()
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, one.collect()))
