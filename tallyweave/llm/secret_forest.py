"""Secret scan: candidates by form, false positives removed by a random forest.

Candidates are runs of key-like characters with letters and digits. What tells a
secret from an address, a path or an identifier is learnt from labelled findings:
length, transitions between characters, how much of it dictionary words cover, the
path of the document and the words beside it. Dictionary and transitions are counted
over all documents.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.session import cut

#: Labelled findings that the query makes for training: the bound of the sample.
LABELLED = 6_000
TREES, DEPTH, SEED = 40, 8, 11
#: Dictionary words stand in at least this share of the documents, so there are at most words-per-document / share of them.
WORD_SHARE = 5e-4
#: Characters looked at on each side.
BESIDE = 48

_RUN = re.compile(r"[A-Za-z0-9+/_.\-]{12,}={0,2}")
_WORD = re.compile(rb"[a-z]{4,12}")
# Words that stand beside secrets, and beside what only looks like one. Fixed lists.
KEY_WORDS = frozenset("password passwd pwd pass secret token key apikey api access auth bearer credential credentials private aws".split())
PLAIN_WORDS = frozenset("commit sha sha1 sha256 md5 hash checksum digest uuid guid id revision version build file path url http https www mail email href src image".split())
PATH_WORDS = frozenset("test tests example examples fixture fixtures mock sample doc docs lock min dist vendor".split())
FEATURES = (
    "length", "letters", "digits", "upper", "symbols", "turns", "transition", "least_transition", "entropy", "covered", "hex", "dots", "slashes",
    "assigned", "quoted", "at_sign", "key_word", "plain_word", "path_word", "path_depth")


@dataclass(frozen=True)
class Language:
    """What the documents say about plain words: a dictionary, and log odds of one letter after another."""

    words: frozenset[str]
    follow: np.ndarray

    def transitions(self, text: str) -> list[float]:
        codes = [_code(c) for c in text.lower()]
        return [float(self.follow[a, b]) for a, b in zip(codes, codes[1:])]

    def covered(self, text: str) -> float:
        """Share of characters inside dictionary words, longest word first at each place."""
        low, at, hit = text.lower(), 0, 0
        while at < len(low):
            n = next((n for n in range(min(12, len(low) - at), 3, -1) if low[at:at + n] in self.words), 0)
            hit += n
            at += n or 1
        return hit / max(1, len(low))


def _code(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 26 if c.isdigit() else 27


def learn_language(docs: DataFrame, text_col: str = "text", share: float = WORD_SHARE) -> Language:
    """Count words over all documents, each once for a document, summed up before they move."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(set(_WORD.findall(text.lower().encode())))
            if len(held) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in held], "n": list(held.values())})
                held = Counter()
        if held:
            yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in held], "n": list(held.values())})

    total = docs.count()
    counts = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = counts.where(F.col("n") >= max(2, math.ceil(total * share))).toArrow()
    seen = np.ones((28, 28))
    words = []
    for word, n in zip(common.column("word").to_pylist(), common.column("n").to_pylist(), strict=True):
        words.append(word)
        codes = [_code(c) for c in word]
        for a, b in zip(codes, codes[1:]):
            seen[a, b] += n
    return Language(frozenset(words), np.log(seen / seen.sum(axis=1, keepdims=True)))


def candidates(text: str | None) -> Iterator[tuple[int, str]]:
    """Runs of at least 12 key-like characters with a letter and a digit: start and text."""
    for m in _RUN.finditer(text or ""):
        run = m.group()
        if run.isalpha():
            continue
        start = m.start() + len(run) - len(run.lstrip("./-"))
        run = run.strip("./-") if not run.endswith("=") else run.lstrip("./-")
        if len(run) >= 12 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            yield start, run


def describe(text: str, start: int, run: str, path: str | None, language: Language) -> list[float]:
    """Features of a candidate, in the order of ``FEATURES``."""
    n = len(run)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in run]
    steps = language.transitions(run)
    before, after = text[max(0, start - BESIDE):start], text[start + n:start + n + BESIDE]
    beside = set(re.findall(r"[a-z0-9]+", " ".join(re.split(r"\s+", before)[-3:]).lower()) + re.findall(r"[a-z0-9]+", " ".join(re.split(r"\s+", after)[:2]).lower()))
    edge = before.rstrip(" \"'")
    parts = re.split(r"[^a-z0-9]+", (path or "").lower())
    return [
        n, sum(k in "ul" for k in kinds) / n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / (n - 1),
        sum(steps) / len(steps), min(steps), -sum(c / n * math.log2(c / n) for c in Counter(run).values()), language.covered(run),
        float(all(c in "0123456789abcdefABCDEF" for c in run)), run.count("."), run.count("/"), float(edge[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'")),
        float(before[-1:] == "@" or after[:1] == "@"), float(not beside.isdisjoint(KEY_WORDS)), float(not beside.isdisjoint(PLAIN_WORDS)),
        float(not PATH_WORDS.isdisjoint(parts)), float((path or "").count("/"))]


def _made(draw: random.Random, words: list[str]) -> tuple[str, str, int]:
    """A labelled finding: what stands before it, itself, and whether it is a secret."""
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    any62 = lambda n: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    word = lambda: draw.choice(words)
    name = draw.choice(("password", "token", "secret", "api_key", "access_key", "pwd"))
    kind = draw.randrange(10)
    if kind == 0:
        return " ", "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), 1
    if kind == 1:
        return f" {name}=", hexes(draw.randint(16, 40)), 1
    if kind == 2:
        return f" {name} = \"", hexes(draw.choice((32, 40, 64))), 1
    if kind == 3:
        return f" {name}: ", any62(draw.randint(20, 48)) + draw.choice("0123456789"), 1
    if kind == 4:
        return " ", draw.choice(("ghp_", "sk_live_", "xoxb-")) + any62(32) + "7", 1
    if kind == 5:
        return f" {word()}.{draw.randint(0, 99):02d}@", f"mail{draw.randint(0, 9)}.example.com", 0
    if kind == 6:
        return " ", f"{word()}/{word()}{draw.randint(0, 99)}/{word()}.{draw.choice(('py', 'html', 'mp4', 'h5'))}", 0
    if kind == 7:
        return f" {draw.choice(('commit', 'sha1', 'checksum', 'revision'))} ", hexes(40), 0
    if kind == 8:
        h = hexes(32)
        return draw.choice((" id=", " uuid ")), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", 0
    return " ", draw.choice(("-", "_", "")).join((word(), word().capitalize(), str(draw.randint(1, 2030)), word())), 0


def labelled_findings(docs: DataFrame, language: Language, rows: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """At most ``rows`` labelled findings: made secrets and look-alikes, each set somewhere into the text of a document drawn by hash."""
    words = sorted(w for w in language.words if len(w) >= 4) or ["word", "name", "page", "text"]
    share = min(1.0, 1.2 * rows / max(1, docs.count()))
    hashed = docs.select(F.xxhash64(F.lit(SEED), F.col(id_col)).alias("h"), F.col(text_col).alias("t"), F.col(path_col).cast("string").alias("p"))
    drawn = hashed.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    held = docs.sparkSession.sparkContext.broadcast(words)

    def make(batches):
        for batch in batches:
            out = {"text": [], "start": [], "run": [], "path": [], "label": [], "h": []}
            for h, t, p in zip(*[batch.column(c).to_pylist() for c in ("h", "t", "p")], strict=True):
                draw, t = random.Random(h), t or ""
                before, run, label = _made(draw, held.value)
                at = t.find(" ", draw.randrange(len(t) + 1))
                at = len(t) if at < 0 else at
                left, right = t[max(0, at - 2 * BESIDE):at], t[at:at + 2 * BESIDE]
                out["text"].append(left + before + run + ("\"" if before.endswith("\"") else "") + right)
                for k, v in (("start", len(left) + len(before)), ("run", run), ("path", p), ("label", label), ("h", h)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out)

    made = drawn.mapInArrow(make, "text string, start long, run string, path string, label long, h long")
    return made.orderBy("h", "text").limit(rows)


def train(findings: DataFrame, language: Language, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel | float:
    """Forest on labelled findings (``text, start, run, path, label``); their number is the caller's bound.

    Findings of one label alone leave nothing to tell apart: the result is that label, as
    the probability of every candidate; without findings it is 0.

    They are few, so they are put in one partition and an order: equal findings give
    equal forests.
    """
    held = findings.sparkSession.sparkContext.broadcast(language)

    def measure(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([describe(r["text"], r["start"], r["run"], r["path"], held.value) for r in rows], pa.list_(pa.float64())),
                pa.array([float(r["label"]) for r in rows], pa.float64())], names=["x", "label"])

    measured = cut(findings.mapInArrow(measure, "x array<double>, label double").repartition(1).sortWithinPartitions("label", "x"), "findings")
    seen = [r.label for r in measured.select("label").distinct().collect()]  # two at most
    if len(seen) < 2:
        return float(seen[0]) if seen else 0.0
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt", featuresCol="v", labelCol="label")
    return forest.fit(measured.select(array_to_vector("x").alias("v"), "label"))


def judged(model: RandomForestClassificationModel | float, df: DataFrame) -> DataFrame:
    """``df`` (features in ``x``) with ``probability`` and ``is_secret`` in place of them."""
    if isinstance(model, float):
        return df.drop("x").withColumn("probability", F.lit(model)).withColumn("is_secret", F.lit(model >= 0.5))
    out = model.transform(df.withColumn("v", array_to_vector("x")))
    p = vector_to_array("probability")[1]
    return out.select(*[c for c in df.columns if c != "x"], p.alias("p")).withColumn("is_secret", F.col("p") >= 0.5).withColumnRenamed("p", "probability")


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each candidate: ``doc_id, start, run, probability, is_secret``.

    ``start`` counts code points from 0. ``findings`` are the labelled findings to learn
    from; without them some are made. Null and empty texts have no candidates; a null path
    is an empty one; equal rows have equal candidates. Where nothing can be learnt (no
    rows), there is nothing to judge either; findings of one label give all candidates
    that label (none: no secrets).
    """
    spark: SparkSession = docs.sparkSession
    empty = "doc_id long, start long, run string, probability double, is_secret boolean"
    if docs.isEmpty():
        return spark.createDataFrame([], empty)
    language = learn_language(docs, text_col)
    found = labelled_findings(docs, language, LABELLED, id_col, text_col, path_col) if findings is None else findings
    model = train(found, language)
    held = spark.sparkContext.broadcast(language)

    def look(batches):
        for batch in batches:
            out = {"doc_id": [], "start": [], "run": [], "x": []}
            for i, t, p in zip(*[batch.column(c).to_pylist() for c in ("i", "t", "p")], strict=True):
                for start, run in candidates(t):
                    out["doc_id"].append(i)
                    out["start"].append(start)
                    out["run"].append(run)
                    out["x"].append(describe(t, start, run, p, held.value))
            yield pa.RecordBatch.from_pydict(out, schema=_CANDIDATES)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.col(path_col).cast("string").alias("p"))
    return judged(model, rows.mapInArrow(look, "doc_id long, start long, run string, x array<double>"))


_CANDIDATES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("run", pa.string()), ("x", pa.list_(pa.float64()))])
