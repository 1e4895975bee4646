"""Markup that looks like boilerplate but holds the page's text."""

import numpy as np

from tallyweave.llm import page_text as p

WEIGHTS = p.fit(np.zeros((0, p.N_FEATURES)), np.zeros(0))


def test_article_headers_by_class():
    for tag in ("header", "div"):
        page = f'<header class="site-header">Site</header><article><{tag} class="entry-header"><h1>Headline</h1></{tag}><p>Text, and more.</p><div class="header-ad">Buy.</div></article>'
        assert p.extract(page, WEIGHTS) == "Headline\nText, and more."


def test_content_inside_a_form():
    page = '<form id="aspnetForm"><nav>Menu</nav><p>Your name, please.</p>{}<p>Send it, now.</p></form>'
    for tag in ("main", "article"):
        inner = f"<{tag}><h1>Title</h1><p>Text, and more.</p><form><p>Sign up, please.</p></form><p>The end.</p></{tag}>"
        assert p.extract(page.format(inner), WEIGHTS) == "Title\nText, and more.\nThe end."
    assert p.extract(page.format("<aside><article><p>Text, and more.</p></article></aside>"), WEIGHTS) == ""
