"""Main text of pages: reading, gradients, held-out accuracy, whole results on the fixture's pages and odd ones."""

import html
import os
import random
import re

import numpy as np
import pytest

from corvane.llm import extraction as ex

FIXTURE = "/root/testdata/sf0.001"
WORDS = "stein fluss 12 berg, wald und la maison grande the river runs".split()


@pytest.fixture(scope="module")
def model():
    return ex.fit([{"key": "1", "steps": [], "texts": [" ".join(WORDS)], "links": []}])


def read(page):
    return [b[1] for b in ex.leaves(page, ex.Paths())]


def test_reading():
    assert read("<p>a &amp; b<br>c\n\t d<p><b>e</i>&nbsp;f</p>&lt;g&gt;") == ["a & b c d", "e f", "<g>"]
    assert read("x<script>var a='</p><p>no'</SCRIPT>y<style>p{}</style><title>t</title><textarea>z</textarea>") == ["x", "y"] == read("x<svg><text>no</text></svg>y")
    assert read("a < b <3 <!-- <p>no --> c <!doctype x> d <? e ?> f </3> g") == ["a < b <3 c d f g"] and read("<!-->a<!-- b") == ["a"]
    assert read("<p title='a>b' class=\"x>\">c</p><p d=e'f>g</p>") == ["c", "g"] and read("a<p ") == ["a"] and read("") == [] and read(" \n<p> </p>") == []
    assert read("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><th>f</table>") == ["a", "b", "c", "d", "e", "f"]
    paths = ex.Paths()
    node = ex.leaves("<div><ul><li>a<li>b</div>c", paths)
    assert node[0][0] == node[1][0] and node[2][0] == 0 and ex.leaves("<a href=x>ab</a> c", paths)[0][2] == 2


def test_reading_takes_proportional_time():
    import time

    for page in ("<div>" * 200_000, "<p =\"" * 200_000, "</b></div>" * 200_000, "<a <a " * 200_000, "<!--" * 200_000, "<script>" * 200_000, "<li><p>" * 100_000 + "x", "&amp" * 200_000):
        start = time.perf_counter()
        ex.leaves(page, ex.Paths())
        assert time.perf_counter() - start < 5, page[:10]


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    layouts, paths = ex._Layouts(WORDS, random.Random(3)), ex.Paths()
    drawn = [ex._marked(layouts.page(), paths) for _ in range(3)]
    blocks, labels = ex._batch(drawn, paths, {})
    model = {k: v.astype(np.float64) for k, v in ex._fresh(rng).items()}
    loss = lambda: float(-np.log(np.where(labels > 0, p := ex._probabilities(model, blocks).astype(float), 1 - p)).mean())
    grad = ex._gradients(model, blocks, labels)
    for name, value in model.items():
        at = np.unravel_index(np.abs(grad[name]).argmax(), value.shape)
        held = value[at]
        value[at] = held + 1e-2
        up = loss()
        value[at] = held - 1e-2
        down = loss()
        value[at] = held
        assert abs((up - down) / 2e-2 - grad[name][at]) < 0.05 * abs(grad[name][at]) + 2e-5, name


def test_drawn_pages_held_out(model):
    """Blocks of layouts with other words and draws than those learnt from."""
    layouts = ex._Layouts(["uno", "due", "tre", "quattro"], random.Random(99))
    total = wrong = 0
    for _ in range(200):
        paths = ex.Paths()
        blocks, labels = ex._marked(layouts.page(), paths)
        got = ex._probabilities(model, ex.Blocks(paths, [blocks], {})) >= 0.5
        total, wrong = total + len(labels), wrong + int((got != labels).sum())
    assert total > 2000 and wrong < 0.01 * total


def test_long_pages_in_chunks(model, monkeypatch):
    """Batches and chunks of any size give the probabilities of each page alone."""
    layouts = ex._Layouts(WORDS, random.Random(5))
    pages = [layouts.page() for _ in range(12)] + ["", "<article>" + "<p>wort fluss berg</p>" * 500 + "</article>"]
    want = [ex.texts([p], model, {})[0] for p in pages]
    assert ex.texts(pages, model, {}) == want and want[-1].count("\n") == 499
    monkeypatch.setattr(ex, "CHUNK", 7)
    monkeypatch.setattr(ex, "SLOTS", 30)
    assert ex.texts(pages, model, {}) == want


def article(page):
    """The article of a fixture page by its tags alone."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    return "\n".join(t for p in parts if (t := " ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split())))


@pytest.mark.skipif(not os.path.isdir(FIXTURE), reason="fixture tables are not here")
def test_fixture(spark):
    from corvane.session import table

    pages = table(spark, FIXTURE, "pages")
    got = ex.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = {r.page_id: article(r.html) for r in pages.collect()}
    rows = got.collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>wort \U0001f600 berg.</p></article>"), (3, "w", "<nav><ul><li><a href=x>Home</a></ul></nav>"), (3, "w", "<nav><ul><li><a href=x>Home</a></ul></nav>"), (4, "x", "<main>" + "<p>wort und berg.</p>" * 3000 + "</main>")]
    df = spark.createDataFrame([(*r, "mine", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in ex.extract(df, model).collect()}
    assert got == {(1, "u"): ("", 0), (2, None): ("", 0), (None, "v"): ("wort \U0001f600 berg.", 12), (3, "w"): ("", 0), (4, "x"): ("\n".join(["wort und berg."] * 3000), 44999)}
    assert ex.extract(df, model).count() == 6 and ex.extract(df.where("false")).collect() == []
