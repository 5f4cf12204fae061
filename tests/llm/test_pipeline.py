import os

import numpy as np
import pytest
from helpers import corpus, docs
from test_pairs import plain_components, plain_fingerprint
from test_scans import plain_base
from test_texts import brute_contamination

import corpus_pipeline
from corvane.llm import common, quality, secrets, tokens
from corvane.session import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables are not here")


def test_pipeline_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "decontamination", "secret_scans", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}

    good = stage["quality_classifier"](spark, docs, SF)
    forest = quality.train(docs, table(spark, SF, "labels"))
    score = forest.score(np.array([quality.statistics(t.encode()) for t in rows.values()]))
    kept = {i: rows[i] for i, s in zip(rows, score, strict=True) if s >= 0.3}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept.keys() and len(kept) < len(rows)

    prints = [(i, plain_fingerprint(t)) for i, t in kept.items()]
    kept = {i: kept[i] for i in set(plain_components(prints))}
    single = stage["near_dedup"](spark, good, SF)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == kept.keys()

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = brute_contamination(list(kept.items()), items)
    kept = {i: t for i, t in kept.items() if not hit[i][4]}
    clean = stage["decontamination"](spark, single, SF)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == kept.keys()

    safe = stage["secret_scans"](spark, clean, SF)
    got = {r.doc_id: r.text for r in safe.collect()}
    assert safe.columns == docs.columns and got.keys() == kept.keys()
    weak = {r.doc_id for r in secrets.scan(clean).where("size(spans) > size(strong)").collect()}
    assert all((got[i] == t) == (not plain_base(t)) for i, t in kept.items() if i not in weak)

    packed = corpus_pipeline.run(spark, SF).collect()
    library = tokens.tokenizer(tokens.default_path())
    sizes = {}
    for r in packed:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in got.items()}
    assert corpus_pipeline.ORACLE_SQL is None


def write_tables(spark, folder, rows):
    documents = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, t in rows if i is not None and t], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, " ".join(dict(rows)[3].split()[2:25])), (2, None), (3, "")], "item_id long, text string") if rows else spark.createDataFrame([], "item_id long, text string")
    for name, df in (("documents", documents), ("labels", labels if rows else labels.limit(0)), ("benchmark", items)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return documents


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids and texts, empty, blank and very long texts, ties, repeated rows and clashing columns go through
    all stages; every id of what is kept lies in one piece."""
    rows = corpus() + [(None, "no id at all " * 9), (None, "no id at all " * 9), (None, None), (5, corpus()[5][1]), (900, "a" + " " * 1_050_000 + "b"), (901, "token = abcdefghijkl é " * 3000), (902, "\u00a0 " * 600_000)]
    documents = write_tables(spark, tmp_path, rows)
    stage = dict(corpus_pipeline.STAGES)
    df = documents
    for name in ("quality_classifier", "near_dedup", "decontamination", "secret_scans"):
        df = common.written(stage[name](spark, df, str(tmp_path)), name)
        assert df.columns == documents.columns and df.count() > 0
    library = tokens.tokenizer(tokens.default_path())
    want = sorted((str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in df.select("doc_id", "text").collect())
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert sorted((str(i), n) for i, n in got.items()) == want
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert 901 not in texts or texts[901] == "[assign] é " * 3000


def test_pipeline_on_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
