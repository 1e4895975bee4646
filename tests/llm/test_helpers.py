"""Range-dealt helpers and components against plain Python."""

import random
from collections import defaultdict

from tallyweave.llm import common, probminhash


def test_running_and_first(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["hot"] * 3 + ["a", None]), draw.randrange(40), i, draw.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v long")
    got = {r.i: (r.before_v, r.same_v) for r in common.running(df, ["k"], ["o"], ["v"]).collect()}
    first = {r.i: r.first_o for r in common.first_in_order(df, ["k"], ["o", "i"]).collect()}
    assert len(got) == len(first) == 400
    for k, o, i, _ in rows:
        mine = [(p, v) for q, p, _, v in rows if q == k]
        assert got[i] == (sum(v for p, v in mine if p < o), sum(v for p, v in mine if p == o))
        assert first[i] == min(p for p, _ in mine)


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + draw.randrange(1, 300)) for _ in range(200)] + [(2000 + draw.randrange(80), 2000 + draw.randrange(80)) for _ in range(50)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.u: r.p for r in probminhash.components(df).collect()}
    assert got == {k: v for k, v in want.items() if near[k] - {k}}
    assert probminhash.components(df.limit(0)).count() == 0


def test_salted_join(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(50)], "k int, i int")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "k int, v string")
    got = {r.i: r.v for r in common.salted_join(left, right, ["k"], "left").collect()}
    assert got == {i: {0: "x", 1: "y"}.get(i % 3) for i in range(50)}
