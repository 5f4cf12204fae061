"""Vector codes against all rows: recall, odd vectors, ties, whole candidates, filters on keys."""

import numpy as np
import pytest

from corvane.operators import codes, indexing


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 10))
    x = middle[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 10))
    data = [(i, v.tolist(), i) for i, v in enumerate(x)]
    data += [(1000 + i, data[5][1], 0) for i in range(6)]  # ties
    data += [(2000, None, 0), (2001, [1.0, 2.0], 0), (2002, [None] * 10, 0), (2003, [float("nan")] * 10, 0), (2004, [0.0] * 10, 0), (2005, [float("inf")] + [0.0] * 9, 0), (2006, [], 0)]
    return spark.createDataFrame(data, "chunk_id long, embedding array<double>, code int").repartition(4).cache()


@pytest.fixture(scope="module")
def learnt(rows):
    cells = indexing.learn_cells(rows.where("chunk_id < 2000"), target=1.0)
    return codes.learn_codes(rows, cells, parts=4)  # ten numbers don't divide by four


def test_every_sound_row_has_one_code(rows, learnt):
    got = codes.code_blocks(rows, learnt, size=50).collect()
    assert sorted(k for b in got for k in b["keys"]) == [*range(900), *range(1000, 1006), 2004]
    assert all(len(b.codes) == 4 * len(b["keys"]) and len(b["keys"]) <= 50 for b in got)


def test_neighbours_by_codes(spark, rows, learnt):
    asked = rows.where("chunk_id % 20 = 0 and chunk_id < 2000").selectExpr("chunk_id as query", "embedding as v")
    blocks = codes.code_blocks(rows, learnt, size=64).cache()
    exact = indexing.neighbours(rows.where("chunk_id < 2000"), asked)
    n = codes.candidates_for(learnt, rows.count())
    assert indexing.recall(exact, codes.neighbours(asked, blocks, rows, learnt, n)).first().recall >= 0.9
    # with every row a candidate, the result is exact
    key = lambda r: (r.query, r.chunk_id, round(r.similarity, 9))
    learnt_all = codes.Codes(indexing.Cells(learnt.cells.centres, len(learnt.cells.centres)), learnt.centres, learnt.sampled, learnt.needed)
    every = codes.neighbours(asked, blocks, rows.where("chunk_id < 2000"), learnt_all, 2000)
    assert sorted(map(key, every.collect())) == sorted(map(key, exact.collect()))


def test_candidates_against_plain_scores(spark, rows, learnt):
    wide = codes.Codes(indexing.Cells(learnt.cells.centres, len(learnt.cells.centres)), learnt.centres, learnt.sampled, learnt.needed)
    asked = rows.where("chunk_id in (5, 40, 300)").selectExpr("chunk_id as query", "embedding as v")
    got = {}
    for r in codes.candidates(asked, codes.code_blocks(rows, wide, size=32), wide, 20, tile=2).collect():
        got.setdefault(r.query, set()).add(r.key)
    sound = rows.where("chunk_id < 2000 or chunk_id = 2004").orderBy("chunk_id").collect()
    x = indexing._unit(np.array([r.embedding for r in sound]))
    cell, code = wide.encode(x)
    back = np.concatenate([wide.centres[p][code[:, p]] for p in range(4)], axis=1)[:, :10] + wide.cells.centres[cell]
    for q in asked.collect():
        v = np.array(q.v) / np.linalg.norm(q.v)
        by = sorted((-round(s, 9), r.chunk_id) for s, r in zip(back @ v, sound, strict=True))
        assert got[q.query] == {k for _, k in by[:20]}


def test_one_question(spark, rows, learnt):
    blocks = codes.code_blocks(rows, learnt).cache()
    query = rows.where("chunk_id = 7").first().embedding
    found = codes.nearest(query, blocks, rows, learnt, 60)
    assert found.first().chunk_id == 7 and found.count() == 10
    assert [r.chunk_id for r in codes.nearest(rows.where("chunk_id = 5").first().embedding, blocks, rows, learnt, 60, k=7).collect()] == [5, *range(1000, 1006)]
    assert codes.nearest([1.0, 2.0], blocks, rows, learnt, 60).count() == 0


def test_filter_on_keys_reaches_the_scan(spark, rows, learnt, tmp_path):
    rows.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    found = codes.nearest([1.0] * 10, codes.code_blocks(rows, learnt), stored, learnt, 30)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(chunk_id" in plan


def test_odd_questions_and_empty_tables(spark, rows, learnt):
    blocks = codes.code_blocks(rows, learnt)
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [None] * 10), (4, [float("nan")] * 10)], "query int, v array<double>")
    assert codes.neighbours(odd, blocks, rows, learnt, 20).count() == 0
    none = rows.where("false")
    empty = codes.learn_codes(none, indexing.learn_cells(none))
    assert codes.code_blocks(none, empty).count() == 0
    assert codes.code_blocks(rows, learnt).where("false").count() == 0
    asked = spark.createDataFrame([(1, [1.0] * 10)], "query int, v array<double>")
    assert codes.neighbours(asked, codes.code_blocks(none, learnt), none, learnt, 20).count() == 0


def test_share_read(learnt):
    wide = codes.Codes(indexing.Cells(np.zeros((1, 64)), 1), np.zeros((16, 256, 4)), 20_000, 200)
    assert codes.share_read(wide, 1_000_000, codes.candidates_for(wide, 1_000_000)) < 0.1
