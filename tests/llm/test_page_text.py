"""Main text of pages: parser, minimum cut and whole pages."""

import itertools
import random

import numpy as np

from tallyweave.llm import page_text as p

WEIGHTS = p.fit(np.zeros((0, p.N_FEATURES)), np.zeros(0))
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">Buy.</div><div id="cookie-banner"><p>We use cookies, many of them.</p></div>
<article><header><h1>Head &amp; more</h1></header><p><b>Bold st<i>art</i>.<br><p>One &lt;two&gt;
 three&nbsp;four &#x263A;</p><p>1 < 2 and 3 &am</p><div class="post-comments"><p>Nice article, I liked it. Thanks.</p></div><form><p>Sign up, please.</p></form>
<aside><p>See also, elsewhere.</p></aside><ul><li>item one<li>item two</ul><p></p></article><footer>&copy; x</footer></body>"""


def test_page():
    assert p.extract(PAGE, WEIGHTS).split("\n") == ["Head & more", "Bold start.", "One <two> three four ☺", "1 < 2 and 3 &am", "item one", "item two"]


def test_odd_pages():
    for page in (None, "", "   ", "<", "<!--", "<p", "</p></p>", "<script>", "<a href='x>", "<article>" * 3000, "<!doctype html>", "\x00"):
        assert p.extract(page, WEIGHTS) in ("", "\x00", "<", "<p", "<a href='x>")
    long = "<article>" + "".join(f"<p>Line {i}, of prose.</p><div class=ad>x</div>" for i in range(5000)) + "</article>"
    assert p.extract(long, WEIGHTS) == "\n".join(f"Line {i}, of prose." for i in range(5000))


def test_min_cut_is_least():
    draw = random.Random(1)
    for _ in range(150):
        n = draw.randrange(1, 9)
        gain = np.array([draw.uniform(-1, 1) for _ in range(n)])
        edges = [(i, j, draw.uniform(0, 0.9)) for i in range(n) for j in range(i + 1, n) if draw.random() < 0.5]
        cost = lambda x: sum(max(g, 0) if not v else max(-g, 0) for g, v in zip(gain, x)) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        assert abs(cost(p.min_cut(gain, edges)) - min(map(cost, itertools.product((0, 1), repeat=n)))) < 1e-9


def test_fit_separates_held_out_blocks():
    draw = random.Random(2)
    def block(good):
        n = draw.randrange(8, 60) if good else draw.randrange(1, 7)
        text = " ".join("word," if draw.random() < 0.1 else "word" for _ in range(n))
        return p.Block(text, "p" if good else draw.choice(("li", "div")), 0, 0, 1, (0,), 0 if good else len(text))
    sets = [[block(i % 2 == 0) for i in range(400)] for _ in range(2)]
    y = np.array([1.0, 0.0] * 200)
    w = p.fit(p.features(sets[0]), y)
    assert (((p.features(sets[1]) @ w) > 0) == (y > 0)).mean() > 0.97


def test_main_text(spark):
    rows = [(1, "u", PAGE, 7), (1, "u", PAGE, 8), (None, None, None, 9), (2, "v", "<article><p>Ü𝒳</p></article>", 1)]
    got = sorted((str(r.page_id), r.url, r.n_chars, r.text) for r in p.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect())
    text = p.extract(PAGE, WEIGHTS)
    assert got == [("1", "u", len(text), text)] * 2 + [("2", "v", 2, "Ü𝒳"), ("None", None, 0, "")]
