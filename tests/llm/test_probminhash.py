"""Signatures, blocks and classes of near-duplicates."""

import random

import numpy as np
import pyarrow as pa

from tallyweave.llm import probminhash as p


def words(draw, n):
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def test_registers_estimate_probability_jaccard():
    """J_P of weighted sets is the sum over common elements of 1 / sum of max(x_i / x_e, y_i / y_e)."""
    draw = random.Random(3)
    names = np.array([draw.getrandbits(63) for _ in range(60)], np.uint64)
    x = np.array([draw.choice((1, 1, 4, 64)) for _ in names]) * np.array([draw.random() < 0.8 for _ in names])
    y = np.array([draw.choice((1, 1, 4, 64)) for _ in names]) * np.array([draw.random() < 0.8 for _ in names])
    wx, wy = np.where(x > 0, p.weight(np.maximum(x, 1)), 0), np.where(y > 0, p.weight(np.maximum(y, 1)), 0)
    want = sum(1 / np.maximum(wx / wx[e], wy / wy[e]).sum() for e in range(60) if wx[e] and wy[e])
    sig = p.signatures([(names[x > 0], x[x > 0]), (names[y > 0], y[y > 0])], registers=4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.035


def test_signatures_do_not_depend_on_the_batch():
    draw = random.Random(4)
    sets = [p.shingles(" ".join(words(draw, n))) for n in (1, 3, 9, 40, 700, 5000)]
    together = p.signatures(sets)
    for s, row in zip(sets, together, strict=True):
        assert (p.signatures([s])[0] == row).all()


def test_short_and_empty_texts():
    assert len(p.shingles(None)[0]) == len(p.shingles(" \n")[0]) == 0
    assert len(p.shingles("a b")[0]) == 1 and p.jaccard("a b", "A  b") == 1.0 and p.jaccard("", "") == 0.0


def test_blocks_find_links_between_classes():
    draw = random.Random(6)
    base = words(draw, 300)
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(words(draw, 300)), " ".join([*base[:200], *words(draw, 100)])]
    sig = p.signatures([p.shingles(t) for t in texts])
    rows = [(i, i, s.tobytes(), t) for i, s, t in zip((7, 3, 5, 9), sig, texts, strict=True)]
    table = pa.table({
        "_row": [r[0] for r in rows] * 2, "comp": [r[1] for r in rows] * 2, "sig": pa.array([r[2] for r in rows] * 2, pa.binary()),
        "text": [r[3] for r in rows] * 2, "minor": [True] * 4 + [False] * 4, "other": [False] * 4 + [True] * 4})
    assert set(zip(*p._crossing(0.8)(table).to_pydict().values(), strict=True)) == {(3, 7)}


def test_chain_whose_leader_knows_one_link(spark, monkeypatch):
    """c is near b but not near a, and a leads: the link is found across classes or by another leader."""
    draw = random.Random(8)
    a = words(draw, 400)
    b = a[:190] + words(draw, 8) + a[198:]
    c = b[:60] + words(draw, 8) + b[68:330] + words(draw, 8) + b[338:]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(words(draw, 400)))]
    sim = lambda i, j: p.jaccard(rows[i][1], rows[j][1])
    assert sim(0, 1) >= 0.8 and sim(1, 2) >= 0.8
    got = {r._raw: (r.class_id, r.class_size) for r in p.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1)}


def test_first_of_classes_keeps_one(spark):
    draw = random.Random(9)
    t = " ".join(words(draw, 100))
    rows = [(5, t, "x"), (5, t, "x"), (3, t + " end", "y"), (None, t, "z"), (8, "alone", "w"), (9, None, "v"), (10, "", "u")]
    kept = p.first_of_classes(spark.createDataFrame(rows, "doc_id long, text string, _id string")).collect()
    assert sorted((r.doc_id, r._2 if False else r[2]) for r in kept) == [(3, "y"), (8, "w"), (9, "v")]
