"""Near copies of which only one repeats a passage."""

import random

from test_probminhash import words

from tallyweave.llm import probminhash as p


def test_links_with_unequal_repeats(spark):
    draw = random.Random(10)
    rows = []
    for i in range(16):
        a = words(draw, 400)
        b = [*a[:370], *words(draw, 30)]
        rows += [(2 * i, " ".join([*a[80:], *a[:80] * 400])), (2 * i + 1, " ".join(b))]
    similar = [p.jaccard(rows[k][1], rows[k + 1][1]) for k in range(0, 32, 2)]
    assert all(0.8 <= s < 0.9 for s in similar), similar
    got = {r._raw: (r.class_id, r.class_size) for r in p.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (k // 2 * 2, 2) for k in range(32)}
