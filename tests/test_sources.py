"""Filters that reach the source, requests by registration; commits that overtake each other, joined folders."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from corvane.operators import merging
from corvane.sources import files, pages
from corvane.sources.store import FAN, Added, Merged, Store


@pytest.fixture
def requests(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    class Backend:
        """One record a request, and a note of what was asked for."""

        def fetch(self, kind, params):
            (log / uuid.uuid4().hex).write_text(f"{kind} {params.get('start_date') or params.get('registration')}")
            return 200, None, {"records": [{"mkey": 1}]}

    spark.dataSource.register(pages.source_of(Backend(), "counted"))
    spark.conf.set(pages.PUSHDOWN, "true")

    def seen():
        found = sorted(f.read_text() for f in log.iterdir())
        for f in log.iterdir():
            f.unlink()
        return found

    return seen


def test_filters_choose_windows(spark, requests):
    year = lambda: pages.read(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31), days=31, name="counted")
    assert year().count() == 12 and len(requests()) == 12
    late = year().where("window_start >= date'2024-10-01' and window_end < date'2024-12-31'")
    assert late.count() == 2 and requests() == ["by_date 2024-10-06", "by_date 2024-11-06"]
    assert year().where("window_start in (date'2024-01-01', date'2024-02-01') and page = 0").count() == 2 and len(requests()) == 2
    assert year().where("window_start = date'2024-01-02'").count() == 0 and requests() == []
    assert year().where("window_start = date'2024-01-01' or page = 5").count() == 1 and len(requests()) == 12  # not a filter on windows alone
    spark.conf.set(pages.PUSHDOWN, "false")
    try:
        assert year().where("window_start > date'2024-11-01'").count() == 2 and len(requests()) == 12
    finally:
        spark.conf.set(pages.PUSHDOWN, "true")


def test_by_registration(spark, requests):
    got = pages.read(spark, registration="N123", name="counted").where("window_start is null").collect()
    assert len(got) == 1 and got[0].window_start is None and '"mkey": 1' in got[0].payload
    assert requests() == ["by_registration N123"]


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "k int, v string")


def content(store, name="t"):
    return sorted((r.k, r.v) for r in store.read(name).collect())


def overtaken(store, other):
    """The store's next commit finds that the other one, given as a function, was made just before its own marker."""
    publish, waiting = store._publish, [other]

    def late(state):
        if waiting:
            waiting.pop()()
        return publish(state)

    store._publish = late


def test_merges_of_different_buckets_both_hold(spark, tmp_path):
    a, b = Store(spark, str(tmp_path), 8), Store(spark, str(tmp_path), 8)
    keys = list(range(40))
    a.commit({"t": Merged(rows(spark, *[(k, "old") for k in keys]), ["k"], merging.overwrite)})
    of = {r.k: r.b for r in a.read("t").select("k", F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(8)).alias("b")).collect()}
    one, two = 0, next(k for k in keys if of[k] != of[0])
    times = []

    def counted(old, new, by):
        times.append(1)
        return merging.overwrite(old, new, by)

    overtaken(a, lambda: b.commit({"t": Merged(rows(spark, (two, "b")), ["k"], merging.overwrite)}))
    assert a.commit({"t": Merged(rows(spark, (one, "a")), ["k"], counted)}) == 3
    assert content(a) == sorted((k, {one: "a", two: "b"}.get(k, "old")) for k in keys) and len(times) == 1


def test_merge_of_the_same_bucket_is_made_anew(spark, tmp_path):
    a, b = Store(spark, str(tmp_path), 1), Store(spark, str(tmp_path), 1)
    a.commit({"t": Merged(rows(spark, (1, "old"), (2, "old")), ["k"], merging.overwrite)})
    overtaken(a, lambda: b.commit({"t": Merged(rows(spark, (2, "b"), (3, "b")), ["k"], merging.overwrite)}))
    a.commit({"t": Merged(rows(spark, (1, "a")), ["k"], merging.overwrite)})
    assert content(a) == [(1, "a"), (2, "b"), (3, "b")]


def test_first_merges_and_additions_overtaken(spark, tmp_path):
    a, b = Store(spark, str(tmp_path), 4), Store(spark, str(tmp_path), 4)
    overtaken(a, lambda: b.commit({"t": Merged(rows(spark, (1, "b")), ["k"], merging.overwrite), "log": Added(rows(spark, (1, "b")))}))
    a.commit({"t": Merged(rows(spark, (2, "a")), ["k"], merging.overwrite), "log": Added(rows(spark, (2, "a")))})
    assert content(a) == content(a, "log") == [(1, "b"), (2, "a")]


def test_replacement_and_tags_overtaken(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.commit({"t": rows(spark, (1, "old"))})
    overtaken(a, lambda: b.commit({"t": rows(spark, (1, "b"))}))
    with pytest.raises(RuntimeError, match="changed t"):
        a.commit({"t": rows(spark, (1, "a"))})
    assert content(a) == [(1, "b")]
    overtaken(a, lambda: b.commit({"log": Added(rows(spark, (1, "x")))}, tag="w"))
    a.commit({"log": Added(rows(spark, (1, "x")))}, tag="w")
    assert content(a, "log") == [(1, "x")]


def test_added_folders_stay_few(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for k in range(2 * FAN + 3):
        store.commit({"log": Added(rows(spark, (k, "x")))})
    assert len(store._state()["tables"]["log"]["folders"]) == 2 + 3
    assert content(store, "log") == [(k, "x") for k in range(2 * FAN + 3)]
    store.prune()
    assert content(store, "log") == [(k, "x") for k in range(2 * FAN + 3)]


def test_pdf_texts_by_an_extractor(spark, tmp_path):
    """Pages are joined by line breaks; a broken file gives null, one without pages an empty text; a file of no bytes has no row; other files are left alone."""
    from corvane.sources import seed

    (tmp_path / "deep").mkdir()
    files = {"a.pdf": b"one\ftwo\fthr\xc3\xa9e", "deep/b.pdf": b"pageless", "e.pdf": b"", "c.pdf": b"broken", "d.txt": b"no"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)

    def extract(content):
        if content == b"broken":
            raise ValueError("no PDF")
        return content.decode().split("\f") if content != b"pageless" else []

    got = {r.path.rsplit("/", 1)[1]: r.text for r in seed.pdf_texts(spark, str(tmp_path), extract).collect()}
    assert got == {"a.pdf": "one\ntwo\nthrée", "b.pdf": "", "c.pdf": None}


def test_text_bundle(spark, tmp_path):
    rows = [("data/raw/wiki/A_B.txt", "a\r\nb  \x00\x1e\"\\"), ("data/raw/pdf_to_txt/é %.txt", None), ("elsewhere/C.txt", "\n"), ("data/raw/wiki/L.txt", "x" * 21_000_000)]
    files.write_texts(spark.createDataFrame(rows[:3] * 20 + rows[3:], "path string, text string").coalesce(2), str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("part-*"))) <= 2  # not a file a text
    got = {r.path: (r.source, r.name, r.text) for r in files.texts(spark, str(tmp_path / "b"), bundled=True).collect()}
    assert got == {"data/raw/wiki/A_B.txt": ("wiki", "A B", rows[0][1]), "data/raw/pdf_to_txt/é %.txt": ("pdf", "é %", ""), "C.txt": ("wiki", "C", "\n"), "data/raw/wiki/L.txt": ("wiki", "L", rows[3][1])}
    assert files.texts(spark, str(tmp_path / "b"), bundled=True).count() == 61


def test_manifest_of_bundle_and_files(spark, tmp_path):
    texts = {"A_B.txt": "a b\r\n", "E %41+é.txt": "", "W.txt": " \t\n"}
    (tmp_path / "data" / "raw" / "wiki").mkdir(parents=True)
    for name, text in texts.items():
        (tmp_path / "data" / "raw" / "wiki" / name).write_bytes(text.encode())
    files.write_texts(spark.createDataFrame([(f"data/raw/wiki/{n}", t) for n, t in texts.items()], "path string, text string"), str(tmp_path / "b"))
    loose, bundled = (sorted(map(tuple, m.collect())) for m in (files.manifest(spark, str(tmp_path / "data")), files.manifest(spark, str(tmp_path / "b"), bundled=True)))
    assert loose == bundled and len(loose) == 3
    assert [r.path.rsplit("/", 1)[1] for r in files.empty_files(spark, str(tmp_path / "data")).collect()] == ["E %41+é.txt"]
