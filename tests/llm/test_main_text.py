"""Block reading against hand-made pages, the LSTM's gradients and batches against plain forms, and extraction on pages held out."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemosail.llm import html_layouts, main_text, queries
from mnemosail.llm.html_blocks import Places, blocks
from tests.conftest import DATA


def texts(page):
    return [b.text for b in blocks(page, Places())[0]]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), ("  \n ", []), ("plain  text\n here", ["plain text here"]),
        ("<p>a<b>b</b>c<br>d<p>e", ["abc d", "e"]),
        ("<p><b>one<br><p>two</p>three", ["one", "two", "three"]),
        ("<P CLASS=x>A&amp;B &eacute;&#233; &lt;i&gt; &copy &am</P>", ["A&B éé <i> © &am"]),
        ("<script>var t='</p><p>no';</script>x<style>p{}</style>y<!-- <p>no --><p>z", ["xy", "z"]),
        ("<title>T &amp; t</title><textarea><p>no</textarea><select><option>no</select><p>yes", ["yes"]),
        ("a < b <1 <é </ é> c", ["a < b <1 <é c"]),
        ('<a href="x>y" title=\'<p>\'>link</a><p data-x="a>b">t', ["link", "t"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<h2>a</h3>b", ["a", "b"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("<p>seen<p unclosed ", ["seen"]), ("seen<!-- never ends <p>x", ["seen"]), ("seen<script>never ends <p>x", ["seen"]),
        ("</div></p>x</b>", ["x"]), ("<?php x ?>a<![CDATA[b]]>c", ["ac"]), ("a&nbsp;　b", ["a b"]), ("<svg><text>no</text></svg><template><p>no</p></template><p>y", ["y"]),
        ("<noscript><p>no</noscript>a<button>b</button>c<hr>d", ["a", "b", "c", "d"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_places_name_what_is_around():
    found, title = blocks('<title>A  b</title><div id="main" class="postBody x2"><p>t<a>link</a></p></div><nav>n</nav>', Places())
    assert title == "A b" and [b.linked for b in found] == [4, 0]
    other, _ = blocks('<div class="body post main x"><p>t</div><nav class=x>n', Places())
    assert (found[0].place.vector == other[0].place.vector).all() and (found[1].place.vector != other[1].place.vector).any()


@pytest.mark.parametrize("page", ["<div>x" * 60_000, "<p>" * 200_000, "<a b='" * 100_000, "<li>" * 60_000 + "x", "<!--" * 100_000, "<i>x</b>" * 60_000, "<script>" * 60_000, "&" * 300_000, "<" * 300_000, "<div><b>x</i>" * 30_000, "<table><tr>" * 40_000])
def test_odd_pages_take_linear_time(page):
    began = time.perf_counter()
    blocks(page, Places())
    assert time.perf_counter() - began < 8


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    sizes, d = np.array([3, 1, 5, 2]), 4
    ahead, back, running = main_text.layout(sizes)
    assert sorted(ahead[:, 0].tolist()) == sorted(back[:, 0].tolist()) == [4, 5, 6, 7, 8] and running.tolist() == [4, 3, 2, 1, 1]
    z, u, g = rng.normal(size=(11, 4 * d)), rng.normal(size=(d, 4 * d)), rng.normal(size=(11, d))
    for rows in (ahead, back):
        def loss(z, u, rows=rows):
            return float((main_text.Direction(u.astype(np.float32)).run(z.astype(np.float32), rows, running) * g).sum())

        it = main_text.Direction(u.astype(np.float32))
        it.run(z.astype(np.float32), rows, running, True)
        dz, du = it.back(g.astype(np.float32), rows, running)
        for array, grad, at in ((z, dz, (4, 1)), (z, dz, (9, 6)), (u, du, (2, 3)), (u, du, (0, 13))):
            up, down = array.copy(), array.copy()
            up[at] += 1e-2
            down[at] -= 1e-2
            slope = (loss(up, u) - loss(down, u)) if array is z else (loss(z, up) - loss(z, down))
            assert slope / 2e-2 == pytest.approx(grad[at], abs=2e-2)


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    return main_text.fit(main_text.sample_sentences(pages))


def plain_lstm(model, vectors):
    """Step by step for one page, gate by gate."""
    w = {k: v.astype(float) for k, v in model.weights.items()}
    d = w["forth"].shape[0]
    z = vectors @ w["x"] + w["bias"]

    def run(z, u):
        h, c, out = np.zeros(d), np.zeros(d), []
        for row in z:
            g = row + h @ u
            i, f, o = (1 / (1 + np.exp(-g[k * d : (k + 1) * d])) for k in range(3))
            c = f * c + i * np.tanh(g[3 * d :])
            h = o * np.tanh(c)
            out.append(h)
        return out

    forth, back = run(z[:, : 4 * d], w["forth"]), run(z[::-1, 4 * d : 8 * d], w["back"])[::-1]
    return [1 / (1 + np.exp(-(np.concatenate([f, b]) @ w["out"][:, 0] + s))) for f, b, s in zip(forth, back, z[:, -1], strict=True)]


def test_batches_equal_pages_one_by_one(model):
    pages = [html_layouts.Composer([], k).page() for k in range(30)] + ["", "<p>x"]
    whole = main_text.Reader(model, most_blocks=60).probabilities(pages)
    for page, (found, p) in zip(pages, whole, strict=True):
        again, title = blocks(page, Places())
        assert [b.text for b in again] == [b.text for b in found]
        if found:
            v = np.concatenate([np.stack([b.place.vector for b in again]), main_text.content_vectors(again, title, main_text.word_buckets())], axis=1)
            assert p == pytest.approx(plain_lstm(model, v), abs=1e-3)


def test_layouts_held_out(model):
    composer, right, n = html_layouts.Composer(["Eins zwei drei.", "Quatre cinq, six sept!", "Ocho nueve diez once doce."] * 3, 12345), 0, 0
    reader = main_text.Reader(model)
    for _ in range(150):
        page = composer.page()
        ((found, p),) = reader.probabilities([page])
        marked, _ = blocks(page, Places(), html_layouts.MARKS)
        right += sum((x >= 0.5) == b.first for x, b in zip(p, marked, strict=True))
        n += len(p)
    assert right / n > 0.97


def article(page):
    """The plain text of the page's article element."""
    inside = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
    found = [" ".join(html.unescape(re.sub("<[^>]*>", "", part.replace("<br>", " "))).split()) for part in re.split("</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in found if x)


def test_pages_equal_their_articles(spark):
    for folder, share in (("sf0.01", 1.0), ("sf0.1", 0.999)):
        pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/{folder}/pages.parquet").collect()}
        got = queries.op11_main_text(spark, f"{DATA}/{folder}").collect()
        assert len(got) == len(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)
        assert sum(r.text == article(pages[r.page_id].html) for r in got) >= share * len(pages)


COMMENTED = """<html><head><title>Deep sea</title></head><body><div id="cookie-banner"><p>We use cookies here. Accept them.</p></div><div class="header"><a href="/">The Site</a></div>
<ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">Sport</a></li></ul><div class="content"><h1>Deep sea</h1><p>Fish live there, in the dark, and they see little.</p>
<div class="ad">Buy fish now.</div><p>Nobody knows how many there are; some say millions.</p></div><div class="sidebar"><h3>Related articles</h3><ul><li><a href="/c">Whales</a></li></ul></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>Ann</p><p>I saw one of them myself, near the coast, last year.</p></div></div><div class="footer">&copy; The Site</div></body></html>"""


def test_edges(spark, model):
    rows_ = [(1, "u", COMMENTED), (1, "u", COMMENTED), (2, None, None), (3, "v", ""), (None, "w", "<nav><a>x</a></nav>"), (4, "x", "<article><h1>T</h1>" + "<p>A long story, told at length.</p>" * 50_000 + "</article>")]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("z"), "_id": F.lit(0)})
    got = main_text.extract(df, model).collect()
    assert len(got) == 6 and got[0] == got[1]
    by = {r.page_id: r for r in got}
    assert by[1].text == "Deep sea\n\nFish live there, in the dark, and they see little.\n\nNobody knows how many there are; some say millions."
    assert (by[2].url, by[2].text, by[2].n_chars, by[3].text, by[None].text) == (None, "", 0, "", "")
    assert by[4].text.count("A long story") == 50_000
    assert main_text.extract(df.limit(0), model).count() == 0
    assert main_text.sample_sentences(df.limit(0)) == [] and len(main_text.sample_sentences(df, main_text.Config(sample_bytes=1500))) > 5
