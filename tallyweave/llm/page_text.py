"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. A classifier, fitted on pages whose markup
tells content from boilerplate, gives each block the cost of either label: its edge
to source and sink. Neighbours in the page, and neighbours under one DOM parent, are
joined by smoothness edges that weaken with their distance in the tree. The minimum
cut of that graph labels all blocks of a page at once.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Pages that the classifier is fitted on, about (the bound of the sample), and blocks of them at most.
FIT_PAGES = 2_000
FIT_BLOCKS = 100_000
#: Strength of the edges between neighbours in the page, and under one parent.
NEXT, SIBLING = 0.4, 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Element and class names, fixed by HTML and by custom.
RAW = frozenset("script style textarea title xmp noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav footer aside form menu button select dialog fieldset head svg".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments discussion disqus reply replies respond sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar "
    "related recommended share sharing social subscribe subscription newsletter signup login form search widget widgets pagination pager skip".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
LAYOUT_WORDS = frozenset("has with without no".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Zone inside a form and no other boilerplate: an article or a main element opens content again.
FORM_ZONE = -2


class Block:
    __slots__ = ("text", "tag", "zone", "parent", "depth", "path", "linked")

    def __init__(self, text: str, tag: str, zone: int, parent: int, depth: int, path: tuple[int, ...], linked: int):
        self.text, self.tag, self.zone, self.parent, self.depth, self.path, self.linked = text, tag, zone, parent, depth, path, linked


def _boiler_name(name: str, inside: bool = False) -> bool:
    """Whether a class or id begins or ends with a word for boilerplate, other than as in ``has-sidebar``, or ``entry-header`` in an article."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return bool(words) and any(w in BOILER_WORDS and not (inside and w == "header") for w in (words[0], words[-1])) and LAYOUT_WORDS.isdisjoint(words)


def _zone(tag: str, attributes: str, zone: int, inside: bool) -> int:
    """Zone that an element opens: 1 content, -1 boilerplate, else that of its parent. Once boilerplate, always, but for a form alone."""
    if zone == -1 or (tag in BOILER_TAGS and tag != "form") or (tag == "header" and not inside):
        return -1
    if attributes:
        for name, a, b, c in _ATTR.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return -1
            if name in ("class", "id") and tag not in ("html", "body") and any(_boiler_name(w, inside) for w in value.split()):
                return -1
            if name == "role":
                if value in BOILER_ROLES:
                    return -1
                if value in ("main", "article"):
                    return 1
    return 1 if tag in CONTENT_TAGS else FORM_ZONE if tag == "form" else zone


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order: decoded, white space as single spaces, trimmed, none empty."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, number, zone, inside an article
    parts: list[str] = []
    linked = number = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                holders = [s for s in stack if s[0] in BLOCK] or [stack[0]]
                parent = holders[-2][1] if len(holders) > 1 else 0
                found.append(Block(text, holders[-1][0], max(stack[-1][2], -1), parent, len(holders), tuple(s[1] for s in holders), min(linked, len(text))))
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        closing, opening = m.group(1), m.group(2)
        if opening:
            tag = opening.lower()
            if tag in BLOCK:
                flush()
                if any(s[0] == "p" for s in stack) and tag != "p" or tag == "p":
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p":
                            del stack[i:]
                            break
                        if stack[i][0] in BLOCK:
                            break
                if tag == "li" and stack[-1][0] == "li":
                    stack.pop()
            elif tag == "br":
                parts.append(" ")
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if tag in VOID or m.group(3).endswith("/") and tag not in BLOCK:
                continue
            number += 1
            links += tag == "a"
            _, _, zone, inside = stack[-1]
            stack.append((tag, number, _zone(tag, m.group(3), zone, inside), inside or tag in CONTENT_TAGS))
        elif closing:
            tag = closing.lower()
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    links -= sum(s[0] == "a" for s in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK and tag not in BLOCK:
                    break
        elif m.group()[:2] in ("<!", "<?") and m.end() - m.start() > 2:
            continue
        else:
            parts.append(m.group())
            if links > 0:
                linked += m.end() - m.start()
    flush()
    return found


N_FEATURES = 8
#: Largest say of a block's text, and the say of its zone where markup tells one.
TEXT_GAIN, ZONE_GAIN = 4.0, 8.0


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: what its text and its own element say."""
    out = np.zeros((len(blocks), N_FEATURES))
    for i, b in enumerate(blocks):
        n = len(b.text)
        out[i] = (
            1.0, min(math.log1p(n) / 8, 1.5), b.linked / n, min((b.text.count(".") + b.text.count(",")) * 20 / n, 1.0),
            b.tag == "p", b.tag in HEADINGS, b.tag == "li", b.tag in ("td", "div", "body", "section", ""))
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        # Nothing to learn from: long prose with few links is content.
        return np.array([-1.0, 2.0, -3.0, 1.0, 1.0, 0.5, -1.0, -0.5])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def gains(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """What labelling each block as content gains: the log odds of its text, and its zone."""
    text = np.clip(features(blocks) @ weights, -TEXT_GAIN, TEXT_GAIN)
    return text + ZONE_GAIN * np.array([b.zone for b in blocks], float)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next, and with the next under the same parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            common = sum(1 for x, y in zip(a.path, b.path) if x == y)
            out.append((i - 1, i, NEXT / (1 + len(a.path) + len(b.path) - 2 * common)))
        j = last.get(b.parent)
        if j is not None and j != i - 1:
            out.append((j, i, SIBLING / (i - j)))
        last[b.parent] = i
    return out


def min_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels of least energy: a node pays ``gain`` if positive and labelled 0, or minus it if negative and labelled 1;
    an edge pays its weight where its ends differ.

    Nodes that outweigh all their edges are settled first, which no cut can better; a
    maximum flow with shortest augmenting paths settles the rest.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    u = gain.astype(float).tolist()
    label = [-1] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] < 0 and abs(u[i]) >= sum(near[i].values()):
            label[i] = int(u[i] > 0)
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] < 0]
    if rest:
        s, t = n, n + 1
        cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        cap[s], cap[t] = {}, {}
        for i in rest:
            if u[i] > 0:
                cap[s][i], cap[i][s] = u[i], 0.0
            elif u[i] < 0:
                cap[i][t], cap[t][i] = -u[i], 0.0
        while True:
            came = {s: s}
            queue = deque([s])
            while queue and t not in came:
                i = queue.popleft()
                for j, c in cap[i].items():
                    if c > 1e-12 and j not in came:
                        came[j] = i
                        queue.append(j)
            if t not in came:
                break
            push, j = math.inf, t
            while j != s:
                push = min(push, cap[came[j]][j])
                j = came[j]
            j = t
            while j != s:
                cap[came[j]][j] -= push
                cap[j][came[j]] = cap[j].get(came[j], 0.0) + push
                j = came[j]
        for i in rest:
            label[i] = int(i in came)
    return np.array(label, np.int8)


def extract(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    labels = min_cut(gains(blocks, weights), edges_of(blocks))
    return "\n".join(b.text for b, x in zip(blocks, labels.tolist(), strict=True) if x)


def fitted(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES, fit_blocks: int = FIT_BLOCKS) -> np.ndarray:
    """Weights from about ``fit_pages`` pages drawn by the hash of their markup, labelled by their zones."""
    share = min(1.0, fit_pages / max(1, pages.count()))
    drawn = pages.select(F.col(html_col).alias("html")).where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def measure(batches):
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = [b for b in blocks_of(page or "") if b.zone]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(features(found).tolist(), pa.list_(pa.float64())), pa.array([int(b.zone > 0) for b in found], pa.int32())], names=["x", "y"])

    rows = drawn.mapInArrow(measure, "x array<double>, y int").limit(fit_blocks).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, N_FEATURES)
    return fit(x, rows.column("y").to_numpy().astype(float))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """One row for each page: ``page_id, url, text, n_chars``.

    ``text`` is the content blocks in page order, one to a line; empty for null and empty
    pages and for pages without content. Equal rows give equal rows; unclosed and crossed
    elements, stray ``<`` and cut-off references are read as browsers mostly do.
    """
    w = fitted(pages, html_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            text = [extract(h, w) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
