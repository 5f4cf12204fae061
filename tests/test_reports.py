import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import measures as M
from corvane.operators import evaluation, merging, reports
from corvane.sources import files
from corvane.sources.store import Added, Merged, Store
from corvane.streaming import feed


def said(spark, column):
    return spark.range(1).select(column).first()[0]


def test_display(spark):
    for value, kind, text in ((None, "score", "N/A"), (0.12345, "score", "0.123"), (0.5, "percent", "50.0%"), (1500.0, "milliseconds", "1.50 s"), (12.4, "milliseconds", "12 ms"), (12345.0, "count", "12,345"), (0.5, "currency", "$0.5000"), (123.45, "score", "123.5")):
        assert said(spark, M.shown(F.lit(value), kind)) == text
    for value, kind, text in ((None, "score", "No baseline"), (0.1, "percent", "+10.0 pp"), (-0.25, "currency", "-$0.2500"), (-3.0, "count", "-3"), (0.5, "score", "+0.500")):
        assert said(spark, M.shown_delta(F.lit(value), kind)) == text
    assert said(spark, M.is_public(F.lit("recall_at_7"))) and not said(spark, M.is_public(F.lit("recall_at_0")))
    assert said(spark, M.label(F.lit("hit_rate_at_3"))) == "HitRate@3" and said(spark, M.label(F.lit("odd_name"))) == "Odd Name"
    assert said(spark, M.normalized_delta(F.lit("duplicate_ratio"), F.lit(0.5))) == -0.5 and said(spark, M.normalized_delta(F.lit("retrieved_tokens"), F.lit(0.5))) is None
    assert [said(spark, M.winner(F.lit(x).cast("double"))) for x in (None, 0.0001, 0.1, -0.1)] == ["Trade-off", "Tie", "A wins", "B wins"]
    assert said(spark, M.top_k(F.lit('{"top_k": "7"}'))) == 7 and said(spark, M.top_k(F.lit('{"top_k": -1}'))) is None and said(spark, M.top_k(F.lit("{}"), F.lit(3))) == 3
    assert said(spark, M.at_cut(F.lit("recall"), F.lit(None).cast("int"))) == "recall_at_5" and said(spark, M.at_cut(F.lit("mrr"), F.lit(3))) == "mrr"


def test_guards(spark):
    metrics = schemas.empty(spark, "metrics")
    with pytest.raises(ValueError):
        reports.metric_history("d", "secret", schemas.empty(spark, "runs"), metrics)
    with pytest.raises(ValueError):
        reports.breakdown("r", metrics, schemas.empty(spark, "cases"), "answer")
    assert reports.compare_runs("a", "b", metrics).count() == 0
    assert reports.delta_histogram(spark.createDataFrame([(1.0,), (1.0,), (None,)], "delta double")).collect()[0][:] == (0, 2)


def test_constraints(spark):
    rows = spark.createDataFrame([("a", "d", False, False), ("a", "d", True, False)], "case_id string, dataset_id string, answerable boolean, expected_abstention boolean").withColumn("reference_answer", F.lit("x"))
    assert schemas.repeated_keys("cases", rows).count() == 1 and {r.rule: r.n for r in schemas.breaches("cases", rows).collect()} == {"answerable or abstention expected": 1, "no answer to what can't be answered": 1}
    assert all(schemas.empty(spark, n).count() == 0 for n in schemas.SCHEMAS) and len(schemas.SCHEMAS) == 19


def test_run_lifecycle(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    cases = spark.createDataFrame([("c1", "d", "draft"), ("c2", "d", "draft"), ("c3", "d", "rejected")], "case_id string, dataset_id string, status string")
    evidence = spark.createDataFrame([("c1", "doc", None, None, 3)], "case_id string, document_id string, parent_id string, chunk_id string, relevance int")

    def target(chosen):
        items = chosen.select("case_id", F.lit(1).alias("rank"), F.lit("doc").alias("item_id"), F.lit("p").alias("parent_id"), F.lit(5).alias("token_count"))
        context = spark.createDataFrame([("c1", 1, "p", 5), ("other", 1, "p", 5)], "case_id string, position int, parent_id string, token_count int")
        return chosen.select("case_id", F.lit("yes").alias("answer"), F.lit(10.0).alias("latency_ms")), items, context

    got = evaluation.run(store, "r1", "d", {}, cases, evidence, target, "2024-01-01")
    assert got.count() == 34
    used, known = store.read("context_items").collect(), store.read("case_runs").where("case_id = 'c1'").first()
    assert [(r.case_run_id, r.position, r.parent_id, r.selected) for r in used] == [(known.case_run_id, 1, "p", True)]
    run = store.read("runs").first()
    assert (run.status, run.total_latency_ms, run.total_cost) == ("completed", 20.0, 0.0)
    summary = {r.metric_name: r.mean_score for r in reports.metric_summary("r1", store.read("metrics")).collect()}
    assert summary["mrr"] == 1.0 and summary["retrieved_items"] == 1.0

    def broken(chosen):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        evaluation.run(store, "r2", "d", {}, cases, evidence, broken, "2024-01-02")
    assert {r.run_id: r.status for r in store.read("runs").collect()} == {"r1": "completed", "r2": "failed"} and store.read("metrics").count() == 34


def test_store_tags(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"t": spark.range(2)}, "b:0")
    store.commit({"t": spark.range(5)}, "b:0")
    assert store.read("t").count() == 2 and store.committed("b:0") and store.tables() == ["t"]


def test_store_writes_what_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k int, v string")
    store.commit({"t": Merged(rows(range(40), "a"), ["k"], merging.overwrite), "log": Added(rows([1], "x"))}, ("f", 0))
    before = store._state()["tables"]
    store.commit({"t": Merged(rows([7], "b"), ["k"], merging.overwrite), "log": Added(rows([2], "y"))}, ("f", 3))
    after = store._state()["tables"]
    assert len(before["t"]["folders"]) == 4 and sum(after["t"]["folders"][b] != f for b, f in before["t"]["folders"].items()) == 1
    assert before["log"]["folders"].items() < after["log"]["folders"].items() and store.read("log").count() == 2
    assert {r.k: r.v for r in store.read("t").collect()} == {k: "b" if k == 7 else "a" for k in range(40)}
    assert store.committed(("f", 2)) and not store.committed(("f", 4)) and not store.committed(("g", 0))
    store.commit({"t": Merged(rows([7], "c"), ["k"], merging.overwrite)}, ("f", 3))
    assert store.read("t").where("v = 'c'").isEmpty() and not list((tmp_path / "_staged").glob("*"))
    store.prune()
    assert store.read("t").count() == 40 and len(list((tmp_path / "t").iterdir())) == 2 and len(list((tmp_path / "_commits").glob("*.json"))) == 1
    # nothing to merge, rows that all go, and a table of no rows
    store.commit({"t": Merged(rows([], ""), ["k"], merging.overwrite), "none": Merged(rows([], ""), ["k"], merging.overwrite)})
    store.commit({"t": Merged(rows(range(40), "d"), ["k"], lambda old, new, key: old.where("false"))})
    assert store.read("t").count() == 0 and store.read("none").columns == ["k", "v"] and store.read("none").isEmpty()
    # null keys, and keys of another width
    store.commit({"t": Merged(rows([None, 1], "e"), ["k"], merging.insert_new)})
    store.commit({"t": Merged(spark.createDataFrame([(1, "f")], "k long, v string"), ["k"], merging.insert_new)})
    assert {(r.k, r.v) for r in store.read("t").collect()} == {(None, "e"), (1, "e")}


def test_files(spark, tmp_path):
    root = tmp_path / "data/raw/wiki"
    root.mkdir(parents=True)
    (root / "A_B.txt").write_text("one\ntwo", encoding="utf-8")
    (root / "E.txt").write_text("", encoding="utf-8")
    manifest = {r.path: r for r in files.manifest(spark, str(tmp_path)).collect()}
    row = manifest["data/raw/wiki/A_B.txt"]
    assert (row.line_count, row.size_bytes, row.is_empty, row.source_type, row.name) == (2, 7, False, "wikipedia", "A B") and manifest["data/raw/wiki/E.txt"].is_empty
    rows = files.manifest(spark, str(tmp_path))
    assert len(files.manifest_digest(rows).first()[0]) == 64 and files.manifest_errors(rows, rows).count() == 0
    assert files.manifest_errors(rows.union(rows), rows.limit(0)).count() == 2 + 4
    texts = files.texts(spark, str(tmp_path)).orderBy("path").collect()
    assert texts[0].text == "one\ntwo" and texts[0].name == "A B"
    from corvane.operators import chunking

    files.write_records(chunking.chunks(files.texts(spark, str(tmp_path))), str(tmp_path / "out"))
    back = files.records(spark, str(tmp_path / "out")).collect()
    assert [(r.text, r.name, r.token_count, r.chunk_id is None) for r in back] == [("one\ntwo", "A B", 2, False)]


def test_stream_restart(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    store = Store(spark, str(tmp_path / "store"))

    def push(rows):
        spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema("k int, at int, v string").parquet(source)
        feed.upsert_stream(stream, store, "t", ["k"], ["at"], state).awaitTermination()
        return {r.k: r.v for r in store.read("t").collect()}

    push([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")])
    assert go() == {1: "c", 2: "b"}
    push([(2, 3, "d"), (3, 1, "e")])
    assert go() == {1: "c", 2: "d", 3: "e"} and go() == {1: "c", 2: "d", 3: "e"}
    counted = feed.counters(spark.createDataFrame([(1, "x"), (1, "y"), (9, "z"), (None, "q")], "case_key int, v string"), spark.createDataFrame([(1,)], "case_key int")).first()
    assert (counted.read, counted.rejected, counted.inserted, counted.updated, counted.repeated) == (4, 1, 1, 1, 1)
