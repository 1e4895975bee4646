"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is a sparse vector: its words (runs of letters, of digits or of other visible
characters, lower-cased) and pairs of neighbouring words are hashed to ``DIM`` places; a
place counts ``1 + ln(times)``, and the vector has length one. Beside them stand a few
shapes, hashed to the same places: one that is always on, the power of two below the
number of words, and how often a word follows itself.

Training reads at most ``TRAIN_ROWS`` labelled texts (those whose identifiers have the
smallest hashes), so its memory is bounded by that parameter; it is one task over stored
vectors and can be repeated. The weights, ``DIM`` numbers at any size of the corpus, go
out with the scoring tasks, which score every row's whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import id_order, text_id
from tallyweave.session import cut

BITS = 18
DIM = 1 << BITS  # places of the hashed vectors
TRAIN_ROWS = 12_000  # labelled texts that training reads at most
EPOCHS = 4
#: Step, its slowness, and the two regularisers of the update rule.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.05
PIECE = 1 << 20  # characters split at a time
SHAPE_VALUE = 0.3

_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_BLANK = re.compile(r"\s")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_seen: dict[str, int] = {}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces that end at white space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + size) if at + size < len(text) else None
        upto = end.start() if end else len(text)
        yield text[at:upto]
        at = upto


def _hashes(words: list[str]) -> np.ndarray:
    if len(_seen) > 300_000:
        _seen.clear()
    for w in words:
        if w not in _seen:
            _seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
    return np.fromiter((_seen[w] for w in words), np.uint64, len(words))


def _places(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)


def _shape(name: str) -> int:
    return int(_places(np.array([zlib.crc32(f"shape {name}".encode())], np.uint64))[0])


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) and values of a text; a null text is an empty one."""
    parts, last, n, again = [], None, 0, 0
    for piece in pieces(text or ""):
        h = _hashes(_WORD.findall(piece.lower()))
        if not len(h):
            continue
        n += len(h)
        run = h if last is None else np.concatenate([last, h])
        again += int((run[1:] == run[:-1]).sum())
        pairs = run[:-1] * np.uint64(31) + run[1:] + np.uint64(1 << 40)
        parts.append(np.unique(np.concatenate([_places(h), _places(pairs)]), return_counts=True))
        last = h[-1:]
    if len(parts) == 1:
        at, times = parts[0]
    elif parts:
        at, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        times = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]))
    else:
        at, times = np.zeros(0, np.int64), np.zeros(0)
    value = 1 + np.log(times)
    if len(value):
        value = value / np.sqrt((value * value).sum())
    share = 0 if not again else 1 + min(3, int(8 * again / n))
    shapes = {_shape(name) for name in ("always", f"words {n.bit_length()}", f"again {share}")}
    at, inverse = np.unique(np.concatenate([at, np.array(sorted(shapes), np.int64)]), return_inverse=True)
    return at, np.bincount(inverse, weights=np.concatenate([value, np.full(len(shapes), SHAPE_VALUE)]))


@dataclass
class Model:
    """Weights of the hashed places."""

    weights: np.ndarray

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        dot = float(self.weights[at] @ value)
        return float(1 / (1 + np.exp(-np.clip(dot, -35, 35))))


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights after ``epochs`` passes of per-coordinate updates over ``(places, values, label)``.

    Each coordinate holds ``z``, the sum of its corrected gradients, and ``n``, that of
    their squares; its weight is the closed-form leader of the regularised sum so far, zero
    while ``|z|`` is at most ``L1``.
    """
    z, n = np.zeros(DIM), np.zeros(DIM)

    def leader(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            at, value, label = rows[i]
            w = leader(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return leader(np.arange(DIM))


def remainder(column: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo 5; a null identifier is the empty text, whose remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``_id, _h, label, text`` of at most ``most`` labelled texts outside the held-out part.

    A document with several labels has the largest. Rows equal in identifier and text
    count once. Null identifiers have no label.
    """
    marks = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(remainder() != 0)
        .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("int").alias("label"))
    )
    named = docs.where("doc_id IS NOT NULL").select(id_order().alias("_id"), text_id().alias("_h"))
    chosen = named.join(marks, "_id").distinct().orderBy(F.xxhash64("_id"), "_id", "_h").limit(most)
    texts = docs.where("doc_id IS NOT NULL").select(id_order().alias("_id"), text_id().alias("_h"), "text")
    return texts.join(cut(chosen, "chosen"), ["_id", "_h"]).dropDuplicates(["_id", "_h"])


def _vectors(batches):
    for batch in batches:
        made = [vector(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_h"), batch.column("label"),
             pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
            ["_id", "_h", "label", "places", "vals"])


def _fit(table: pa.Table) -> pa.Table:
    order = table.sort_by([("_id", "ascending"), ("_h", "ascending")])
    rows = [
        (np.asarray(a.values, np.int64), np.asarray(v.values, np.float64), y.as_py())
        for a, v, y in zip(order.column("places"), order.column("vals"), order.column("label"), strict=True)
    ]
    w = follow_the_leader(rows)
    at = np.flatnonzero(w)
    return pa.table({"place": pa.array(at, pa.int32()), "weight": pa.array(w[at], pa.float64())})


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Model of ``labels(doc_id, quality)`` over ``docs(doc_id, text)``; without labelled rows every score is 0.5."""
    rows = training_rows(docs, labels, most)
    made = cut(rows.mapInArrow(_vectors, "_id long, _h long, label int, places array<int>, vals array<float>"), "vectors")
    fitted = made.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_fit, "place int, weight double").collect()
    weights = np.zeros(DIM)
    for r in fitted:
        weights[r.place] = r.weight
    return Model(weights)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row ``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts are scored by their shape alone. Repeated rows are scored each;
    columns other than ``doc_id`` and ``text`` are not read, so their names can't clash.
    """
    weights = model.weights.astype(np.float32)

    def run(batches):
        judge = Model(weights)
        for batch in batches:
            got = [judge.score(*vector(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64())], ["doc_id", "held_out", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", (remainder() == 0).alias("held_out"), "text")
    scored = asked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return scored.select("doc_id", "held_out", F.round("score", 6).alias("score"), (F.round("score", 6) >= threshold).cast("int").alias("predicted"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` scored by a model of ``labels``: see ``score``."""
    return score(docs, train(docs, labels))
