"""Learned operators: held-out accuracy, and defined results on odd rows."""

import html
import random
import re

import numpy as np
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from tidemark.llm import compression_quality, html_labeller
from tidemark.llm.html_blocks import leaves

SF = "/root/testdata/sf0.1"


def test_compression_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = compression_quality.query(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    rank = got.score.rank()
    ones = got.quality == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.98
    assert abs(got.score.mean() - got.quality.mean()) < 0.02


def test_compression_quality_edges(spark, documents):
    docs = documents(ODD).withColumn("label", F.lit("x")).withColumn("x", F.lit(1))
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert {r.score for r in compression_quality.query(docs, none).collect()} == {0.5}
    few = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, 1, None), (5, 0, 0), (5, 1, 0), (7, 0, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0), (11, None, 0)], none.schema)
    got = compression_quality.query(docs, few).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert compression_quality.query(docs.limit(0), few).count() == 0


def test_dictionaries_see_whole_documents(spark, documents):
    """What marks long texts as good or bad only far behind their start is in the dictionaries."""
    rows = [(k, "plain words " * 1500 + (" goodmark" if k % 2 else " rottenmark") * 6000) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id LONG, quality INT")
    model = compression_quality.fit(documents(rows), labels)
    assert b"goodmark" in model.good and b"rottenmark" in model.bad


# -- HTML ---------------------------------------------------------------------------------------------------------------

PAGES = "page_id LONG, url STRING, html STRING"
PAGE = ("<html><head><title>No</title><style>p{}</style><script>var x='</p>';</script></head><body><header><p>Site name</p></header>"
        "<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>A &amp; B</h1><p>One&nbsp;two\n\t three <b>bold<p>Next &lt;p&gt; <!-- no -->para<div class=ad>Buy this now</div>"
        "<ul><li>first<li>second</ul><section class=comments><h3>Comments</h3><p>nice post</p></section></article>"
        "<aside><p>See also</p></aside><form><label>Name</label><textarea>no</textarea></form><footer>&copy; 2024</footer>")
TEXT = "A & B\nOne two three bold\nNext <p> para\nfirst\nsecond"


@pytest.fixture(scope="module")
def labeller(spark):
    return html_labeller.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_labeller_on_the_whole_table(spark, labeller):
    """The marked article of every page, found without looking for its mark."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_labeller.extract(pages, labeller).collect()}
    for r in pages.collect():
        part = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", part))
        assert got[r.page_id] == "\n".join(x for x in lines if x)


def test_labeller_on_layouts_it_never_saw(labeller):
    rng = random.Random(77)
    pages = [html_labeller.made_page(rng) for _ in range(300)]
    got = labeller.main([p[0] for p in pages])
    assert np.mean(np.concatenate([a == p[1] for a, p in zip(got, pages)])) > 0.97


def test_labeller_edges(spark, labeller):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain < text"), (5, "u", "<p" * 2000), (None, "u", "<article><p>" + "word " * 60_000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))
    got = html_labeller.extract(df, labeller).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id == 1] == [TEXT, TEXT]
    assert {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert next(r.text for r in got if r.page_id is None) == ("word " * 60_000).strip()
    assert html_labeller.query(df.limit(0)).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = html_labeller.Labeller()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = html_labeller.padded([rng.normal(0, 1, (n, html_labeller.DIM)) for n in (3, 5)], [rng.integers(0, 2, n) for n in (3, 5)])
    _, g = net.gradients(x.astype(np.float64), mask, y)
    for name in ("wh", "b", "wx", "wo"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old, eps = net.p[name][at], 1e-4
        net.p[name][at] = old + eps
        up, _ = net.gradients(x, mask, y)
        net.p[name][at] = old - eps
        down, _ = net.gradients(x, mask, y)
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-4


def test_leaves_of_tag_soup():
    assert [t for _, t, _ in leaves("<p>a<b>b<p>c</b>d<table><tr><td>e<td>f<tr><td>g</table>h<br>i</p>j")] == ["ab", "cd", "e", "f", "g", "h i", "j"]


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>x</title><body><article><p>one<p>two</article>", ["one", "two"]),
    ("<html><head><title>x</title><style>p{}</style><article><p>one</article>", ["one"]),
    ("<p>a</p><svg viewBox='0 0 1 1'/><p>b</p><svg><path d='x'/></svg><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><svg><g><svg><text>no</text></svg><text>no</text></g></svg><p>b</p>", ["a", "b"]),
    ("<p>a</p><svg><path d='x'/><text>no</text><p>b</p>", ["a", "b"]),
    ("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>no</annotation></math> hold <math/>here</p><p>b", ["let x=2 hold here", "b"]),
    ("<div><select><option>no<option>no</div>a<div><textarea>no</div>b<p>c", ["a", "b", "c"]),
    ("<div><select><option>no</option><p>a</div><textarea>no</textarea>b", ["a", "b"]),
    ("<ul><li><button>no<li>a</ul><script>no</script>b<script>no<p>no", ["a", "b"]),
    ("<title>no<body>a<style>p</style>b", ["ab"]),
])
def test_elements_without_text_lose_nothing_else(page, want):
    assert [t for _, t, _ in leaves(page)] == want


def test_deep_pages_keep_their_paths():
    """Two thousand nested elements before and inside the article: end tags close what they opened, nothing outside."""
    deep = "<div>" * 2000 + "deep" + "</div>" * 2000
    blocks = leaves(f"<body><nav><ul><li>menu</li></ul></nav><article>{deep}<p>after</p></article><footer>end</footer></body>")
    paths = {text: path for path, text, _ in blocks}
    assert [text for _, text, _ in blocks] == ["menu", "deep", "after", "end"]
    assert paths["deep"].count("div") == 2000 and paths["after"] == ("body", "article", "p") and paths["end"] == ("body", "footer")
    lost = leaves("<body><article>" + "<div>" * 3000 + "x" + "</div>" * 10 + "</article><p>after</p></body>")
    assert [(p[:2], t) for p, t, _ in lost] == [(("body", "article"), "x"), (("body", "p"), "after")]


def test_dictionaries_of_small_samples_see_every_text():
    """A sample of 300 kB in 60 texts whose marks lie in its first documents: they are in the dictionary, trained or thinned."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    texts = [(" ".join(["earlymark" if k < 20 and i % 9 == 0 else rng.choice(words) for i in range(730)])).encode() for k in range(60)]
    assert 290_000 < sum(map(len, texts)) < 320_000
    made = compression_quality.dictionary(texts)
    assert b"earlymark" in made and len(made) <= compression_quality.DICTIONARY_BYTES
    thin = compression_quality.thinned([b"a" * 200_000, b"Z" * 200_000], 1000)
    assert len(thin) <= 1100 and abs(thin.count(b"a") - thin.count(b"Z")) <= 2 * compression_quality.THIN
    assert compression_quality.dictionary([b"one", b"two"]) == b"one\ntwo" and compression_quality.dictionary([]) == b""
