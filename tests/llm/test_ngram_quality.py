"""Quality classifier: held-out accuracy, no leak of held-out labels, odd input."""

import random
import zlib

import numpy as np
from test_tables import prose

from tallyweave.llm import ngram_quality as nq


def corpus(draw, n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = prose(draw, draw.randrange(12, 60)).split()
        if bad and i % 2:
            words = [w + draw.choice(("###", "$$$", "|")) for w in words]
        elif bad:
            words = [words[0]] * len(words)
        rows.append((i, " ".join(words), "s", 0.5))
        labels.append((i, 0 if bad else 1, 7))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_no_leak(spark):
    rows, labels = corpus(random.Random(1), 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = {r.doc_id: r for r in nq.classified(docs, marks).collect()}
    assert len(got) == 500 and all(r.held_out == held(i) for i, r in got.items()) and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted == y for i, y, _ in labels if held(i)]) > 0.95
    flipped = spark.createDataFrame([(i, 1 - y if held(i) else y, 7) for i, y, _ in labels], "doc_id long, quality int, text int")
    again = {r.doc_id: r.score for r in nq.classified(docs.repartition(5), flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_odd_rows(spark):
    rows = [(1, "one two three", "a"), (1, "one two three", "a"), (None, "x y", None), (2, None, None), (3, "", "b"), (4, "a" * 100_000 + " b" * 100_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    schema = "doc_id long, quality int"
    for marks in ([], [(1, 1)], [(1, 0), (1, 1), (None, 1), (3, None), (9, 1), (4, 5)]):
        got = nq.classified(docs, spark.createDataFrame(marks, schema)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and next(r for r in got if r.doc_id is None).held_out
        if not marks:
            assert {r.score for r in got} == {0.5}
    assert nq.classified(docs.limit(0), spark.createDataFrame([(1, 1)], schema)).collect() == []


def test_vector_in_pieces_equals_one(monkeypatch):
    text = prose(random.Random(2), 400) + " same same same $$$ 12"
    at, value = nq.vector(text)
    monkeypatch.setattr(nq, "PIECE", 50)
    monkeypatch.setattr(nq.pieces, "__defaults__", (50,))
    at2, value2 = nq.vector(text)
    assert at.tolist() == at2.tolist() and np.allclose(value, value2) and len(list(nq.pieces(text))) > 5
    assert abs(np.sqrt((value ** 2).sum()) - 1) < 0.3 and (np.diff(at) > 0).all()


def test_updates_follow_the_regularised_leader():
    """Weights go the way of their labels; a place with next to no gradient stays zero."""
    rows = [(np.array([3, 9]), np.array([1.0, 0.5]), 1), (np.array([3]), np.array([1.0]), 0), (np.array([9, 11]), np.array([0.7, 0.001]), 1)]
    w = nq.follow_the_leader(rows, epochs=2)
    assert w[9] > w[3] and w[9] > 0 and w[11] == 0 and np.count_nonzero(w) == 2
