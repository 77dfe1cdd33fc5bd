"""Reading and extraction of pages."""

import itertools
import math

import numpy as np
import pytest

from panelforge.llm import html_extract as H
from panelforge.llm.html_tree import attributes, read
from panelforge.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return H.fit(labelled_pages())


def blocks(html):
    return read(html)[1]


def test_reading():
    assert blocks("<p>a  b\n c<p>d<br>e</p>f") == ["a b c", "d e", "f"]
    assert blocks("<p>x &amp;&lt;b&gt; &copy;&#233;</p>") == ["x &<b> ©é"]
    assert blocks('<script>var t="</p>";</script><style>p{}</style><p>ok<!-- <p>no --></p><!-- open') == ["ok"]
    assert blocks("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert blocks('<p title="a>b">q</p><p class="x>y</p>') == ["q", "y"]
    assert blocks("1 < 2 <") == ["1 < 2 <"]
    assert blocks(None) == blocks("") == []
    assert blocks("<div>" * 5000 + "deep") == ["deep"]


def test_marginals_equal_enumeration():
    page = '<div class="a"><p>one two</p><ul><li>x</li><li><a>y</a></li></ul></div><p>z</p>'
    names, rng = H.Names(), np.random.default_rng(1)
    weights, pair = rng.normal(size=H.BUCKETS), rng.normal(size=(H.KINDS, 2, 2))
    forest = H.Forest([read(page), read("<p>k</p>")], names)
    got, joint = forest.marginals(weights, pair)
    unary = np.bincount(forest.rows, weights[forest.cols], forest.n)
    total, ones, pairs = 0.0, np.zeros(forest.n), np.zeros((forest.n, 2, 2))
    for y in itertools.product((0, 1), repeat=forest.n):
        score = sum(u for u, v in zip(unary, y, strict=True) if v) + sum(pair[forest.kind[k], y[p], y[k]] for k, p in enumerate(forest.parent) if p >= 0)
        w = math.exp(score)
        total += w
        ones += w * np.array(y)
        for k, p in enumerate(forest.parent):
            if p >= 0:
                pairs[k, y[p], y[k]] += w
    assert np.allclose(got, ones / total) and np.allclose(joint, pairs / total)


def test_held_out_pages(model):
    names, wrong, seen = H.Names(), 0, 0
    for page in labelled_pages(150, seed=77):
        nodes, texts = read(page)
        p, _ = H.Forest([(nodes, texts)], names).marginals(model.weights, model.pair)
        labels = []
        for k, node in enumerate(nodes):
            own = attributes(node.attrs).get(H.LABEL)
            labels.append(int(own) if own is not None else labels[node.parent] if node.parent >= 0 else 0)
            if node.blocks:
                seen += 1
                wrong += (p[k] > 0.5) != labels[k]
    assert wrong < 0.08 * seen


PAGE = """<html><head><title>T</title></head><body><header><div class="logo">My Site</div><nav><a href=1>Home</a></nav></header>
<div class="cookie-notice"><p>We use cookies. <a href=x>OK</a></p></div><article><h1>Title &amp; more</h1><p><b>First para<br><p>with
  text.</p><div class="ad">Buy now</div><ul><li>one<li>two</ul></article><section id="comments"><p>great post!</p></section>
<form><input><p>Subscribe</p></form><footer>&copy; all rights</footer></body></html>"""


def test_main_text(spark, model):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "y"), (4, "w", "<p>" + "word " * 200_000 + "</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.main_text(df, model).collect()
    assert len(out) == 5 and out[0] == out[3]
    assert out[0].text == "Title & more\n\nFirst para\n\nwith text.\n\none\n\ntwo" and out[0].n_chars == len(out[0].text)
    assert out[1].text == out[2].text == "" and out[1].n_chars == 0
    assert H.main_text(df.limit(0), model).count() == 0


def test_reader_keeps_what_follows_foreign_elements():
    from panelforge.llm.html_tree import read

    for inside in ("<svg/>", "<svg width=1 />", "<math/>", "<object data=x>", "<svg><path/>", "<template>"):
        assert " ".join(read(f"<p>one {inside} two</p><p>three</p>")[1]).split() == ["one", "two", "three"], inside
    for tag in ("math", "object", "noscript"):
        assert " ".join(read(f"<p>one</p><{tag}>two</{tag}><p>three</p>")[1]).split() == ["one", "two", "three"], tag
    assert read("<p>one</p><svg><text>no</text></svg><script>no")[1] == ["one"]


def test_deep_pages_take_linear_time(model):
    import time

    took = []
    for depth in (2000, 8000):
        page = "".join(f'<div class="c{i}">' for i in range(depth)) + "words of the page " * 9 + "</div>" * depth
        began = time.process_time()
        model.texts([page], H.Names())
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5
