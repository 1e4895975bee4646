"""Near words by the trie frontier against all pairs."""

import random
import re
import zlib

import pytest

from tallyweave.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows):
    counts = {}
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            w = run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run
            counts[w] = counts.get(w, 0) + 1
    v = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, form = {}, {}
    for w, n in v.items():
        others = [x for x in v if near(w, x)]
        best = min(others, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= 2 * n else None
        out[w] = len(others)
    rows = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, v[w], out[w], v[form[w]] if form[w] else None))
    return sorted(map(str, rows))


def texts(draw, n):
    stems = ["".join(draw.choice("abß") for _ in range(draw.randrange(4, 9))) for _ in range(25)]
    stems += ["".join(draw.choice("aé") for _ in range(40)) for _ in range(2)] + ["k" * 70 + "tail", "k" * 5, "k" * 6]
    rows = []
    for i in range(n):
        words = []
        for _ in range(30):
            w = draw.choice(stems)
            k, edit = draw.randrange(len(w) + 1), draw.randrange(5)
            w = w[:k] + draw.choice("abÉ") + w[k:] if edit == 0 else w[:k] + w[k + 1:] if edit == 1 else w[:k] + draw.choice("abé") + w[k + 1:] if edit == 2 else w
            words.append(w.upper() if draw.random() < 0.1 and w.isascii() else w)
        rows.append((i, draw.choice(" 1-").join(words), "x"))
    rows.append((n + 5, "mmmmm " * 4 + "mmmmmn " * 9 + "mmmmmno " * 20, None))
    return [*rows, (None, rows[0][1], None), (n, None, None), (n + 1, "", "y"), rows[1], rows[1], (n + 2, "q" * 3000 + " " + "q" * 2999 + "r", "z")] + [(n + 3, ("q" * 3000 + " ") * 3 + ("q" * 1500 + "w" + "q" * 1499 + ";") * 4, None)]


@pytest.mark.parametrize("letters", [64, 2])
def test_equals_all_pairs(spark, monkeypatch, letters):
    monkeypatch.setattr(spelling, "LETTERS", letters)
    rows = texts(random.Random(letters), 60)
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string, word string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    have = got.collect()
    assert sorted(str(tuple(r)) for r in have) == brute(rows)
    assert sum(r.form is not None for r in have) > 20 and any(r.root != r.form for r in have if r.form) and max(len(r.word) for r in have) >= 3000


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "abc abc")], "doc_id long, text string")
    assert spelling.variants(df).collect() == [] and spelling.variants(df.limit(0)).collect() == []


def test_no_join_is_broadcast(spark):
    """Spark sizes exploded states by the table of words, so it would broadcast what is many times over its limit."""
    words = spark.createDataFrame([(w,) for w in ("cabine", "cabina", "cabinet")], "word string")
    texts = spelling.sides(words)
    edges = spelling.edge_table(texts).cache()
    states = spelling.first_edits(texts.cache(), edges).cache()
    docs = spark.createDataFrame([(1, "cabine cabine cabine cabina cabina cabina")], "doc_id long, text string")
    for df in (states, spelling.next_level(states, edges), spelling.variants(docs)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
