"""Proximity matches over stored segments against brute force."""

import math
import random

from tallyweave.llm import positional as pos


def stretches(words, terms, span, share):
    need, wanted = max(1, math.ceil(share * len(set(terms)) - 1e-9)), set(terms)
    ok = {(s, e) for s in range(len(words)) for e in range(s + 1, min(len(words), s + span) + 1) if len(wanted.intersection(words[s:e])) >= need}
    return {(s, e) for s, e in ok if not {(s + 1, e), (s, e - 1)} & ok}


def brute(docs, items, window, span, share):
    out = {}
    for i, t in docs:
        words = pos.words_of(t)
        for item, text in items:
            terms = pos.words_of(text)
            for k in range(max(1, len(terms) - window + 1) if terms else 0):
                for s in stretches(words, terms[k:k + window], span, share):
                    out.setdefault((i, t or "", item), set()).add(s)
    return sorted((str(i), t, str(item), sorted(s)) for (i, t, item), s in out.items())


def test_near_hits(spark, monkeypatch):
    draw = random.Random(12)
    docs = [(i, " ".join(draw.choice("abcdefghijkl") for _ in range(draw.randrange(0, 40)))) for i in range(40)] + [(None, "a b c d e f"), (7, None), (8, "")]
    docs += [docs[3]]
    items = [(str(i), " ".join(draw.choice("abcdefghijkl") for _ in range(draw.randrange(1, 9)))) for i in range(12)] + [("3", "l k j"), (None, "a b c d"), ("x", None), ("y", "zz")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for size, span, share in ((50_000, 6, 0.7), (5, 9, 1.0)):
        monkeypatch.setattr(pos, "BLOCK_ITEMS", size)
        monkeypatch.setattr(pos, "SEGMENT_BYTES", 300)
        ids = {r.h: r.t for r in d.selectExpr("xxhash64(coalesce(text, '')) AS h", "coalesce(text, '') AS t").collect()}
        got = sorted((str(r._raw), ids[r._h], str(r["item"]), [(s.start, s.end) for s in r.spans]) for r in pos.near_hits(d, b, window=5, span=span, share=share).collect())
        assert got == brute(docs, items, 5, span, share) and len(got) > 40


def test_inserted_and_changed_words_are_found(spark):
    draw = random.Random(13)
    passage = [f"p{i}" for i in range(13)]
    other = lambda: [f"w{draw.randrange(50)}" for _ in range(60)]
    docs = [(1, passage), (2, [*passage[:6], "new", *passage[6:]]), (3, [*passage[:6], "new", *passage[7:]]), (4, passage[::2])]
    d = spark.createDataFrame([(i, " ".join([*other(), *x, *other()])) for i, x in docs], "doc_id long, text string")
    b = spark.createDataFrame([("q", " ".join(passage))], "item_id string, text string")
    assert {r._raw for r in pos.hits(d, b).where("n_hit > 0").collect()} == {1}
    got = {r._raw: [(s.start, s.end) for s in r.spans] for r in pos.near_hits(d, b).collect()}
    assert got == {1: [(60, 72), (61, 73)], 2: [(60, 73), (61, 74)], 3: [(60, 73)]}
