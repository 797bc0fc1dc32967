"""Main text: messages against all states, slopes, pages of other make, broken markup."""

import itertools
import random

import numpy as np
import pytest

from airgrid.llm import dom, html_text

PROSE = [
    "The river rose in the night, and by the morning it had reached the lower houses of the village.",
    "Nobody was hurt. The council, which had met twice that week, opened the school to those who had to leave.",
    "It will take some days until the water is gone & the bridge can be used again, an engineer said.",
]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def brute(model, x, parent, kind):
    """Marginals and joint chances from the weights of all states."""
    n, score, pairs, total = len(x), np.zeros(len(x)), np.zeros((len(x), 2, 2)), 0.0
    for states in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(s * (x[i] @ model.node) for i, s in enumerate(states)) + sum(model.edge[kind[i], states[parent[i]], states[i]] for i in range(n) if parent[i] >= 0))
        total += w
        score += w * np.array(states)
        for i in range(n):
            if parent[i] >= 0:
                pairs[i, states[parent[i]], states[i]] += w
    return score / total, pairs / total


def test_messages_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(5):
        parent = np.array([-1, 0, 0, 1, 1, 2, 4, 4, 0])
        depth = np.array([0, 1, 1, 2, 2, 2, 3, 3, 1])
        kind = rng.integers(0, html_text.EDGES, 9)
        m = html_text.Model(rng.normal(size=3), rng.normal(size=(html_text.EDGES, 2, 2)))
        x = rng.normal(size=(9, 3))
        p, pair = html_text.marginals(m, x, parent, kind, dom.levels(depth))
        want, joint = brute(m, x, parent, kind)
        assert np.allclose(p, want)
        assert np.allclose(np.moveaxis(pair, 2, 0)[1:], joint[1:])


def test_fit_raises_the_likelihood():
    rng = random.Random(2)
    arrays = html_text._arrays([dom.parse(html_text.compose(rng, PROSE, ["Home", "Contact us"])) for _ in range(30)])
    x, parent, kind, depth, label = arrays
    right = lambda m: ((html_text.marginals(m, x, parent, kind, dom.levels(depth))[0] >= 0.5) == label).mean()
    assert right(html_text.fit(*arrays, rounds=2)) < right(html_text.fit(*arrays, rounds=100)) > 0.98


PAGES = [
    # A page of bare divs.
    f"<html><head><title>x</title></head><body><div id='menu'><ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul></div><div class='content'><h1>Flood</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div><div class=footer>All rights reserved</div></body></html>",
    # Comments, which look like prose, a form, a notice and a sidebar.
    f"<body><header><h2>The Daily</h2></header><div class='cookie-notice'><p>We use cookies to improve this site, and those of our partners.</p></div><main><h1>Flood</h1><p>{PROSE[0]}<p>{PROSE[1]}</main><aside class=sidebar><p>Related stories of the week</p></aside>"
    f"<section id=comments><p>{PROSE[2].replace('&', 'and')}</p><p>I was there and saw it all, what a night.</p></section><form action=/s><p>Your name</p><input></form><footer>Imprint</footer>",
    # An advert inside the article.
    f"<body><nav><a href=/>Home</a></nav><article><h1>Flood</h1><p>{PROSE[0]}</p><div class='ad sponsored'><p>Buy a boat now!</p></div><p>{PROSE[1]}</p></article><footer>x</footer>",
]


@pytest.mark.parametrize("page", PAGES)
def test_pages_of_other_make(model, page):
    assert html_text.main_texts(model, [page]) == ["\n".join(["Flood", *PROSE[:2]])]


def test_long_lists_and_short_texts(model):
    lines = [f"line {i}" for i in range(400)]
    around = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{}</article><footer>&copy; some site</footer></body></html>"
    got = html_text.main_texts(model, [around.format("".join(f"<p>{x}</p>" for x in lines)), around.format("<p>No.</p>"), around.format(""), "", "<", "plain words"])
    assert got[:4] == ["\n".join(lines), "No.", "", ""]


def runs(page):
    return [text for _, text, _ in dom.parse(page).runs]


def test_parser():
    assert runs("a<p>b<p>c <i>d</i>\n\t e</p>f") == ["a", "b", "c d e", "f"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert runs("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert runs("<p title='a>b' data-x=\"</p>\" alt=don't>x &lt;b&gt; &amp &#233;&nbsp;y</p>") == ["x <b> & é y"]
    assert runs("<script>if (a < b) '</p>'</script>x<style>p{}</style><!-- <p>no --><noscript>n</noscript><select><option>o</select>y<button>b</button>") == ["xy"]
    assert runs("<!DOCTYPE html><b>bold<p>in</b> out<br>next</p>") == ["bold", "in out next"]
    assert runs("1 < 2 <3 <div") == ["1 < 2 <3"]
    assert runs("<script>never closed <p>x") == []
    assert runs("</p></div>x</body></html> y") == ["x y"] or runs("</p></div>x</body></html> y") == ["x", "y"]
    deep = dom.parse("<div>" * 5000 + "x" + "</div>" * 5000 + "y")
    assert [t for _, t, _ in deep.runs] == ["x", "y"] and max(deep.depth) <= dom.DEEPEST + 1


def test_query_table(spark, model):
    rows = [(1, "u", PAGES[0], 5), (1, "u", PAGES[0], 6), (2, None, None, 7), (None, "v", "", 8), (3, "w", "<p>" + "word " * 400_000, 9)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    want = "\n".join(["Flood", *PROSE[:2]])
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in got) == [(0, "v"), (1, "u"), (1, "u"), (2, ""), (3, "w")]
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert all(r["text"] == "" for r in got if r["page_id"] in (2, None))


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    model = html_text.train(none)
    assert html_text.extract(none, model).collect() == []
    assert html_text.main_texts(model, PAGES) == ["\n".join(["Flood", *PROSE[:2]])] * 3
