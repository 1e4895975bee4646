"""R-tree search for hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from tallyweave.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string, tree string"


def brute(rows):
    ok = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab, *_ in rows
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * float(np.float32(x))) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, lab, v in ok:
        if i is None or i % 5:
            continue
        positives = sorted(((dot(v, w), j) for j, m, w in ok if m == lab and j != i), key=key)[:hn.POSITIVES]
        for ps, j in positives:
            fit = sorted(((s, n) for n, m, w in ok if m != lab for s in [dot(v, w)] if 50 * ps <= 100 * s <= 95 * ps), key=key)
            out += [(i, j, rank + 1, n, ps, s) for rank, (s, n) in enumerate(fit[:hn.NEGATIVES])]
    return sorted(map(str, out))


def made(draw, n, dims, spread=1.0):
    middles = [[draw.gauss(0, spread) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = middles[draw.randrange(6)]
        rows.append((i, [x + draw.gauss(0, 0.4 * spread) for x in c], draw.randrange(3), None, "x"))
    rows += [(n, None, 1, None, None), (n + 1, [1.0] * dims, None, None, None), (n + 2, [math.nan] * dims, 1, None, None), (n + 3, [None] + [1.0] * (dims - 1), 1, None, None),
             (n + 4, [math.inf] + [0.0] * (dims - 1), 2, None, None), (None, rows[3][1], 1, None, None), (n + 5, [], 1, None, None), (n + 6, rows[4][1][:2], 2, None, None)]
    rows += [rows[5], rows[5], rows[7], (n + 10, *rows[5][1:])]
    rows += [(n + 20 + i, rows[9][1], i % 2, None, None) for i in range(60)]
    return rows


@pytest.mark.parametrize("spread", [0.2, 300.0, 1e6])
def test_equals_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "LEAST_TREE", 40)
    monkeypatch.setattr(hn, "MOST_TREE", 50)
    monkeypatch.setattr(hn, "QUERY_ROWS", 30)
    monkeypatch.setattr(hn, "SLICE", 7)
    rows = made(random.Random(int(spread)), 150, 5, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hn.hard_negatives(df, hn.F.col("_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_empty_and_without_partners(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5], 1, None, None)], SCHEMA)
    assert hn.hard_negatives(df, hn.F.col("_id") % 5 == 0).collect() == []
    assert hn.hard_negatives(df.limit(0), hn.F.col("_id") % 5 == 0).collect() == []


def test_search_prunes_and_stays_exact(monkeypatch):
    """Far-off clusters are never multiplied, and the answer is that of all rows."""
    draw = np.random.default_rng(3)
    middles = draw.normal(0, 400, (12, 8))
    v = np.floor(np.concatenate([m + draw.normal(0, 6, (200, 8)) for m in middles]))
    order = hn.pack_order(v)
    assert sorted(order.tolist()) == list(range(len(v)))
    tree = hn.Tree(v[order], order.astype(np.int64), np.zeros(len(v), np.int64))
    asked = v[::97]
    ids, labels = np.arange(0, len(v), 97), np.zeros(len(asked), np.int64)
    low, high = np.full((len(asked), 1), -10**12), np.full((len(asked), 1), 10**12)
    leaves = []
    whole = hn._exact
    monkeypatch.setattr(hn, "_exact", lambda a, kind: whole(a, kind).view(_Counted) if a is tree.vectors else whole(a, kind))
    _Counted.seen = leaves
    got = tree.search(asked, labels, ids, low, high, 5, True)
    for i, q in enumerate(asked):
        s = v @ q
        want = sorted(((-x, j) for j, x in enumerate(s) if j != ids[i]))[:5]
        assert [(-r[2], r[3]) for r in got if r[0] == i] == want
    assert len(leaves) < 0.6 * len(asked) * len(tree.levels[0][0])


class _Counted(np.ndarray):
    seen: list = []

    def __getitem__(self, at):
        out = np.asarray(super().__getitem__(at))
        self.seen.append(at)
        return out
