import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import lexical
from corvane.operators import indexing, metrics, retrieval


@pytest.fixture(scope="module")
def seed(spark):
    rows = [("c1", "parent-vector", [1.0, 0.0], "vector evidence"), ("c2", "parent-keyword", [0.9, 0.435], "rareword evidence"), ("c3", "parent-third", [0.0, 1.0], "unrelated evidence"), ("c4", "orphan", [1.0, 0.0], "rareword"), ("c5", None, [1.0, 0.0], "rareword"), ("c6", "parent-third", None, "x")]
    children = spark.createDataFrame(rows, "chunk_id string, parent_id string, embedding array<float>, text string")
    parents = spark.createDataFrame([("parent-vector", "V"), ("parent-keyword", "K"), ("parent-third", "T")], "parent_id string, text string")
    return children, parents


def test_hybrid(seed):
    children, parents = seed
    kept = children.where("coalesce(parent_id, '') <> 'orphan'")
    rows = retrieval.hybrid(kept, parents, [1.0, 0.0], "rareword").collect()
    assert [r.parent_id for r in rows] == ["parent-keyword", "parent-vector", "parent-third"]
    assert rows[0].rrf_score == pytest.approx(1 / 61 + 1 / 62) and rows[1].rrf_score == pytest.approx(1 / 61)
    rows = retrieval.hybrid(kept, parents, [1.0, 0.0], "nothing").collect()
    assert [r.parent_id for r in rows] == ["parent-vector", "parent-keyword", "parent-third"]
    assert [r.parent_id for r in retrieval.hybrid(children, parents, [1.0, 0.0], "rareword", k=10).collect()][0] != "orphan"
    seen = retrieval.verdict(retrieval.hybrid(kept, parents, [1.0, 0.0], "rareword")).first()
    assert (seen.both, seen.only_vector, seen.only_keyword) == (1, 2, 0)
    assert retrieval.hybrid(kept.limit(0), parents, [1.0, 0.0], "rareword").count() == 0
    assert [r.parent_id for r in retrieval.hybrid(kept, parents, [1.0, 0.0], "rarewords", ranking="bm25").collect()][0] == "parent-keyword"


def test_nearest(seed):
    children, parents = seed
    assert [r.chunk_id for r in retrieval.nearest(children, [1.0, 0.0], 3).collect()] == ["c1", "c4", "c5"]
    assert [r.chunk_id for r in retrieval.nearest(children, [1.0, 0.0], 3, F.col("parent_id") == "parent-third").collect()] == ["c3"]
    assert [(r.parent_id, r.chunk_id) for r in retrieval.nearest_parents(children, parents, [1.0, 0.0], 2).orderBy(F.desc("similarity")).collect()] == [("parent-vector", "c1"), ("parent-keyword", "c2")]
    plan = retrieval.nearest(children, [1.0, 0.0], 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_term_filters(spark):
    df = spark.createDataFrame([("Alpha beta",), ("gamma",), (None,)], "t string").withColumn("w", lexical.terms(F.col("t")))
    assert df.where(lexical.matches_any(F.col("w"), ["alpha", "zeta"])).count() == 1
    assert df.where(lexical.matches_all(F.col("w"), ["alpha", "beta"])).count() == 1
    assert df.where(lexical.matches_all(F.col("w"), [])).count() == df.where(lexical.matches_any(F.col("w"), [])).count() == 0


def test_budget(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "c"), (4, "")], "i int, text string")
    assert [r.i for r in retrieval.context_budget(df, [F.col("i")], most=4).orderBy("i").collect()] == [1]
    assert retrieval.context_budget(df, [F.col("i")], most=6).count() == 4


def test_metadata(spark):
    rows = spark.createDataFrame([(1, "A B", "wiki", None, None, None, "abcde"), (2, "C", "pdf", "given", None, 7, "x"), (3, None, None, None, None, None, None), (4, "D E", "wiki", "mine", None, 1, ""), (5, "F", "pdf", None, "other/F.txt", 1, "")], "i int, name string, source string, document_id string, source_file string, token_count long, text string")
    manifest = spark.createDataFrame([("data/raw/wiki/A B.txt", "known"), ("data/raw/wiki/D_E.txt", "theirs")], "path string, document_id string")
    got = {r.i: r for r in retrieval.fill_metadata(rows, manifest).collect()}
    assert (got[1].document_id, got[1].source_file, got[1].token_count) == ("known", "data/raw/wiki/A B.txt", 2)
    assert got[2].document_id == "given" and got[2].token_count == 7 and got[3].document_id is None and got[3].token_count == 0
    assert (got[4].document_id, got[4].source_file) == ("mine", "data/raw/wiki/D_E.txt") and got[2].source_file is None
    assert got[5].source_file == "other/F.txt" and len(got[5].document_id) == 16


def test_measures(spark):
    ranked = spark.createDataFrame([("a", i + 1, p, p, 10) for i, p in enumerate(["p2", "p1", "p3", "p4"])], "case_id string, rank int, item_id string, parent_id string, token_count int")
    qrels = spark.createDataFrame([("a", "p1", 3), ("a", "p2", 1), ("a", "p3", 2)], "case_id string, item_id string, relevance int")
    got = {r.metric_name: r.score for r in metrics.evaluate(ranked, qrels).collect()}
    assert len(got) == 17
    assert (got["recall_at_3"], got["precision_at_3"], got["mrr"]) == (1.0, pytest.approx(2 / 3), 0.5) and got["ndcg_at_3"] == pytest.approx(0.7364, abs=1e-4)


def test_measures_edges(spark):
    ranked = spark.createDataFrame([("a", 1, "a", "p", 100), ("a", 2, "a", "p", 120), ("a", 3, "b", "q", 80), ("n", 1, "x", None, None)], "case_id string, rank int, item_id string, parent_id string, token_count int")
    qrels = spark.createDataFrame([("a", "b", 3)], "case_id string, item_id string, relevance int")
    got = {(r.case_id, r.metric_name): r.score for r in metrics.evaluate(ranked, qrels, (3,), cases=spark.createDataFrame([("a",), ("n",), ("e",)], "case_id string")).collect()}
    assert got["a", "mrr"] == 0.5 and got["a", "unique_parent_ratio"] == pytest.approx(2 / 3) and got["a", "duplicate_ratio"] == pytest.approx(1 / 3) and got["a", "retrieved_tokens"] == 300
    for case in ("n", "e"):
        assert [got[case, f"{m}_at_3"] for m in ("recall", "precision", "hit_rate", "ndcg")] == [1.0, 0.0, 0.0, 1.0]
    assert got["e", "unique_parent_ratio"] == 1.0 and got["e", "retrieved_items"] == 0
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            metrics.check_cuts([bad])
    assert metrics.cuts_for({"k_values": [1, 2]}) == (1, 2) and metrics.cuts_for({"top_k": 7}) == (7,) and metrics.cuts_for({}) == (3, 5, 10)


def test_postings_equal_scan(spark, tmp_path):
    """Scores from stored postings are those of a scan, plain and stemmed; a query reads the buckets of its terms only."""
    rows = [(f"c{i}", f"p{i % 7}", " ".join(["crash", "wings", "winged", "fuel", "the"][(i * k) % 5] for k in range(1, 3 + i % 9))) for i in range(60)] + [("e", "p1", None), ("o", None, "fuel")]
    children = spark.createDataFrame(rows, "chunk_id string, parent_id string, text string")
    for stem in (False, True):
        path = f"{tmp_path}/{stem}"
        indexing.postings(children, stem).write.partitionBy("bucket").parquet(path)
        index, stats = spark.read.parquet(path), indexing.sizes(children, stem)
        wanted = lexical.query_terms("wing fuel", stem)
        terms = lexical.terms(F.col("text"))
        scan = lexical.bm25(children.withColumn("t", lexical.stemmed(terms) if stem else terms), "chunk_id", "t", wanted)
        got = {r.chunk_id: r.score for r in indexing.keyword_scores(index, stats, wanted).collect()}
        assert got == pytest.approx({r.chunk_id: r.score for r in scan.collect()}) and got
        leg = [tuple(r) for r in retrieval.keyword_leg(children, wanted, ranking="bm25").collect()] if stem else None
        assert leg is None or sorted(leg) == sorted(tuple(r) for r in indexing.keyword_leg(index, stats, wanted).collect())
        assert "PartitionFilters: [isnotnull(bucket" in (plan := indexing.keyword_scores(index, stats, wanted)._jdf.queryExecution().toString()) or "bucket" in plan.split("PartitionFilters")[1][:120]
    assert indexing.keyword_scores(index, stats, []).count() == 0


def test_postings_of_twin_rows(spark, monkeypatch):
    """A child's rows of one size are one, as are their terms; rows that come once are counted without an exchange by chunk."""
    rows = [("a", "p", "x y x"), ("a", "p", "x z z"), ("a", "p", "x"), ("b", None, "y"), ("c", "p", ""), ("d", "q", None), (None, "q", "y y")]
    schema = "chunk_id string, parent_id string, text string"
    twins = indexing.postings(spark.createDataFrame(rows, schema))
    got = sorted((r.term, r.chunk_id or "", r.size, r.tf, r.df) for r in twins.collect())
    assert got == [("x", "a", 1, 1, 2), ("x", "a", 3, 3, 2), ("y", "", 2, 2, 3), ("y", "a", 3, 1, 3), ("y", "b", 1, 1, 3), ("z", "a", 3, 2, 1)]
    assert [f.dataType.simpleString() for f in twins.schema] == ["int", "string", "string", "string", "bigint", "int", "bigint"]
    once = indexing.postings(spark.createDataFrame([rows[0], *rows[3:]], schema)).select("term", "chunk_id", "tf", "df")
    assert sorted((r.term, r.chunk_id or "", r.tf, r.df) for r in once.collect()) == [("x", "a", 2, 1), ("y", "", 2, 3), ("y", "a", 1, 3), ("y", "b", 1, 3)]
    plan = once._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin [term" in plan and "hashpartitioning(chunk_id" not in plan
    monkeypatch.setattr(indexing, "COMMON", 1)
    some = indexing.postings(spark.createDataFrame([rows[0], *rows[3:]], schema)).select("term", "chunk_id", "tf", "df")
    assert sorted(map(str, some.collect())) == sorted(map(str, once.collect()))


def test_cells(spark):
    """Every row is in a cell; exact neighbours of clustered vectors are found in few cells."""
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(0, 0.2, 16)]) for i in range(900)] + [(1000, None)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    cells = indexing.learn_cells(df)
    index = indexing.with_cells(df, cells)
    assert index.count() == 901 and index.where("cell is null").count() == 1 and 1 <= cells.probes <= len(cells.centres) // 3
    queries = df.where("chunk_id % 20 = 0 and embedding is not null").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("v"))
    exact, found = indexing.neighbours(df, queries), indexing.neighbours(index, queries, cells=cells)
    r = indexing.recall(exact, found).first()
    assert r.queries == 45 and r.recall >= 0.9
    query = rows[40][1]
    plain = [x.chunk_id for x in retrieval.nearest(df, query, 10).collect()]
    assert len({x.chunk_id for x in indexing.nearest(index, cells, query, 10).collect()} & set(plain)) >= 8
    mine = [x.chunk_id for x in exact.where("query = 40").orderBy(F.desc("similarity")).collect()]
    assert mine == plain
    assert indexing.learn_cells(df.limit(0)).probes == 1


def test_neighbours_meet_as_matrices(spark, monkeypatch):
    """Many blocks and shares give what a plain scan gives, with ties, odd vectors and unknown similarities; no pairs are made by a join."""
    monkeypatch.setattr(indexing, "BLOCK", 16)
    monkeypatch.setattr(indexing, "SHARE", 4)
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(150)] + [(200, [0.0] * 3), (201, [1.0]), (202, [1.0, None, 2.0]), (203, None), (204, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = df.where("chunk_id % 20 = 0 or chunk_id > 200").selectExpr("chunk_id as query", "embedding as v")
    got = {}
    found = indexing.neighbours(df, asked, 5)
    for r in found.collect():
        got.setdefault(r.query, []).append((None if r.similarity is None else -round(r.similarity, 9), r.chunk_id))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:150]}
    for i in range(0, 150, 20):
        want = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in unit)[:5]
        assert [s for s, _ in sorted(got[i])] == [s for s, _ in want]
    assert got[200] == got[204] == [(None, i) for i in range(5)]
    assert got[201] == [(-1.0, 201)] and 203 not in got and 202 not in got
    assert "CoGroup" in found._jdf.queryExecution().toString()  # pairs are met by matrices, not by rows


def test_cells_of_a_small_sample(spark):
    """Cells look at enough of them for rows that they were not learnt from, among all rows: vectors without structure, a sixth of them sampled."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(6000, 64)))], "chunk_id long, embedding array<float>").repartition(3).cache()
    cells = indexing.learn_cells(df, sample=1000)
    queries = df.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("v"))
    found = indexing.neighbours(indexing.with_cells(df, cells), queries, cells=cells)
    r = indexing.recall(indexing.neighbours(df, queries), found).first()
    assert r.queries == 300 and r.recall >= 0.945 and cells.probes < len(cells.centres)


def test_copies_rank_by_key_in_all_blocks(spark, monkeypatch):
    """A product's last bits depend on the shape of its block; copies still rank by key, and no more than k of them leave a block."""
    monkeypatch.setattr(indexing, "BLOCK", 7)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(9, 64)).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v[i % 9]) for i in range(270)], "chunk_id long, embedding array<float>").repartition(3)
    asked = df.where("chunk_id < 9 or chunk_id % 50 = 0").selectExpr("chunk_id as query", "embedding as v")
    for cells in (None, indexing.Cells(np.array(v, float), 9)):
        got = {}
        for r in indexing.neighbours(df if cells is None else indexing.with_cells(df, cells), asked, 5, cells).collect():
            got.setdefault(r.query, []).append(r.chunk_id)
        assert {q: sorted(c) for q, c in got.items()} == {q: [q % 9 + 9 * j for j in range(5)] for q in got} and len(got) == 14
