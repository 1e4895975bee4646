"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is a set of word shingles with weights. Each shingle is a Poisson
process of arrivals whose rate is its weight and which fall on random registers; a
register keeps the shingle that arrives first. Two documents agree on a register
with the probability Jaccard similarity. Arrivals are drawn only up to a horizon at
which all registers are filled, so most shingles stop after one draw. The classes
are made of links by plain Jaccard, so their signatures give all distinct shingles
of a document one weight: repeats don't lower the agreement.

Documents that agree on a band of registers are candidates. Each is compared with
its bucket's leader, on the texts themselves. What a leader can't settle, buckets
whose documents lie in several classes, is compared in blocks inside tasks. No task
holds a whole bucket and no pair of a bucket is emitted unless it is a likely link.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from tallyweave.llm.common import LAST_ID, first_in_order, id_order, packed, salted_join, text_id, two_hashes, unpacked
from tallyweave.session import cut

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: A pair is verified if its registers' agreement is within so many standard deviations of the limit.
SLACK = 5.0
#: Documents of a bucket that one task compares at once.
BLOCK = 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and how often each occurs; of fewer words, all words are one shingle."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(min(len(words), size)), np.uint64)
        for k in range(min(size, len(words))):
            out = _mix(out * _GOLD + h[k:k + n])
    return np.unique(out, return_counts=True)


def weight(counts: np.ndarray) -> np.ndarray:
    """Weight of a shingle: repeats count, but less and less, so that similar sets stay similar."""
    return 1.0 + 0.25 * np.log2(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures (16 bits a register) of documents with at least one shingle.

    Arrival k of a shingle comes from hashes of (shingle, k): exponential gaps at the
    shingle's rate, and a register each. All documents advance together, arrival by
    arrival, and a shingle stops when it passes its document's horizon. Documents with
    an empty register go on to twice the horizon, where the arrivals so far repeat.
    """
    out = np.zeros((len(sets), registers), np.uint16)
    horizon = np.array([registers * (np.log(registers) + 4.0) / max(1e-9, weight(c).sum()) for _, c in sets])
    todo = np.arange(len(sets))
    with np.errstate(over="ignore"):
        while len(todo):
            elements = np.concatenate([sets[d][0] for d in todo])
            rate = np.concatenate([weight(sets[d][1]) for d in todo])
            doc = np.repeat(np.arange(len(todo)), [len(sets[d][0]) for d in todo])
            limit = horizon[todo][doc]
            time = np.zeros(len(elements))
            seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            step = 0
            while len(elements):
                step += 1
                r = _mix(elements + _GOLD * np.uint64(2 * step))
                time = time - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
                on = time <= limit
                elements, rate, doc, limit, time, r = elements[on], rate[on], doc[on], limit[on], time[on], r[on]
                place = (_mix(r ^ _GOLD) >> np.uint64(32)).astype(np.int64) * registers >> 32
                seen.append((doc * registers + place, time, elements))
            where, when, who = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.lexsort((when, where))
            where, who = where[order], who[order]
            first = np.concatenate([[True], where[1:] != where[:-1]]) if len(where) else np.zeros(0, bool)
            full = np.bincount(where[first] // registers, minlength=len(todo)) == registers
            keep = full[where[first] // registers]
            w = where[first][keep]
            out[todo[w // registers], w % registers] = (_mix(who[first][keep]) >> np.uint64(48)).astype(np.uint16)
            todo = todo[~full]
            horizon[todo] *= 2
    return out


def _bands(sig: np.ndarray, bands: int) -> np.ndarray:
    """64-bit key of each band of each signature."""
    parts = sig.reshape(len(sig), bands, -1).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD), parts.shape[:2]).copy()
        for k in range(parts.shape[2]):
            key = _mix(key * _GOLD + parts[:, :, k])
    return key.view(np.int64)


def plain(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, each counted once."""
    found, counts = shingles(text)
    return found, np.ones_like(counts)


def _signed(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for at in range(0, len(texts), 128):
            sets = [plain(t) for t in texts[at:at + 128]]
            some = [i for i, (h, _) in enumerate(sets) if len(h)]
            sig = signatures([sets[i] for i in some]) if some else np.zeros((0, BANDS * ROWS), np.uint16)
            data: list[bytes | None] = [None] * len(sets)
            for i, row in zip(some, sig, strict=True):
                data[i] = row.tobytes()
            part = batch.slice(at, len(sets))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("_id", "_h", "h1", "h2")] + [pa.array(data, pa.binary())], names=["_id", "_h", "h1", "h2", "sig"])


def _banded(batches):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        keys = _bands(sig, BANDS)
        at = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1), pa.int64()), batch.column("_id").take(pa.array(at)), batch.column("_row").take(pa.array(at))], names=["key", "_id", "_row"])


def agreement(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Share of equal registers: estimates the probability Jaccard similarity, which is the plain one for equal weights."""
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1)
    return (x == y).mean(axis=1)


def least_agreement(similarity: float = SIMILARITY) -> float:
    return similarity - SLACK * float(np.sqrt(similarity * (1 - similarity) / (BANDS * ROWS)))


def jaccard(a: str | None, b: str | None) -> float:
    """Common share of the distinct shingles of two texts."""
    x, y = shingles(a)[0], shingles(b)[0]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


@F.pandas_udf(DoubleType())
def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(agreement(a.tolist(), b.tolist())) if len(a) else pd.Series([], dtype="float64")


@F.pandas_udf(DoubleType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _attached(pairs: DataFrame, rows: DataFrame, side: str, value: str, name: str, spread: int = 64) -> DataFrame:
    """``pairs`` with ``value`` of the row at ``side``. A row that is in very many pairs is copied to ``spread`` places at most."""
    p = pairs.withColumn("_s", F.pmod(F.xxhash64("b" if side == "a" else "a"), F.lit(spread)))
    copies = p.select(side, "_s").distinct().join(rows.select(F.col("_row").alias(side), F.col(value).alias(name)), side)
    return p.join(copies, [side, "_s"]).drop("_s")


def _links(pairs: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts reach ``similarity``. Signatures tell most of the others; only texts in likely pairs move."""
    p = _attached(_attached(pairs, signed, "b", "sig", "sb"), signed, "a", "sig", "sa")
    likely = cut(p.where(_agree("sa", "sb") >= least_agreement(similarity)).select("a", "b"), "likely")
    t = _attached(_attached(likely, texts, "b", "text", "tb"), texts, "a", "text", "ta")
    return cut(t.where(_similar("ta", "tb") >= similarity).select("a", "b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """Root of every node of ``edges`` (a, b): the smallest node that it is linked with.

    Each round every node points at its smallest neighbour, pointers are followed to
    their ends by doubling, and the edges are drawn between the ends. Stars and chains
    shrink by a factor each round; all tables are written, none is collected.
    """
    roots = None
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while roots is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = cut(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("p")).select("u", F.least("u", "p").alias("p")), "up")
        while True:
            above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = cut(salted_join(up, above, ["p"], spread=F.col("u")).select("u", "q", (F.col("p") != F.col("q")).alias("moved")), "up")
            up = jumped.select("u", F.col("q").alias("p"))
            if jumped.where("moved").isEmpty():
                break
        roots = up if roots is None else cut(
            salted_join(roots, up.select(F.col("u").alias("p"), F.col("p").alias("q")), ["p"], "left", F.col("u")).select("u", F.coalesce("q", "p").alias("p")), "roots")
        pa_, pb = up.select(F.col("u").alias("a"), F.col("p").alias("ra")), up.select(F.col("u").alias("b"), F.col("p").alias("rb"))
        e = salted_join(salted_join(edges, pa_, ["a"], spread=F.col("b")), pb, ["b"], spread=F.col("a"))
        edges = cut(e.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return roots


def _crossing(similarity: float):
    def crossed(table: pa.Table) -> pa.Table:
        """Links between the rows of two blocks of one bucket that lie in different classes.

        Signatures are compared first, then the texts. Classes that a link has joined here
        are one from then on, so there are fewer links than classes.
        """
        minor, other = table.filter(table.column("minor")), table.filter(table.column("other"))
        out_a, out_b = [], []
        if minor.num_rows and other.num_rows:
            x, y = (np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, -1) for t in (minor, other))
            cx, cy, rx, ry, tx, ty = (t.column(c).to_pylist() for c in ("comp", "_row", "text") for t in (minor, other))
            up = {c: c for c in (*cx, *cy)}

            def root(c):
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            known: dict[int, frozenset] = {}

            def of(row, text):
                if row not in known:
                    known[row] = frozenset(shingles(text)[0].tolist())
                return known[row]

            least = least_agreement(similarity) * x.shape[1]
            for i in range(len(x)):
                for j in np.flatnonzero((y == x[i]).sum(axis=1) >= least).tolist():
                    a, b = root(cx[i]), root(cy[j])
                    if a != b:
                        s, t = of(rx[i], tx[i]), of(ry[j], ty[j])
                        both = len(s & t)
                        if both >= similarity * (len(s) + len(t) - both):
                            up[a] = b
                            out_a.append(min(rx[i], ry[j]))
                            out_b.append(max(rx[i], ry[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return crossed


def _across(members: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between classes inside buckets.

    ``members``: key, _row, comp, of buckets with several classes. The rows outside a
    bucket's largest class are compared with all of it, block by block.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    major = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all")).select(
        "key", F.col("m.comp").alias("major"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int").alias("minors"))
    m = salted_join(members, major, ["key"], spread=F.col("_row"))
    m = m.join(signed.select("_row", "sig"), "_row").join(texts, "_row")
    mine = F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int")
    some = F.pmod(F.xxhash64("_row", F.lit(1)), F.greatest("minors", F.lit(1))).cast("int")
    first = m.where("comp <> major").select("key", "_row", "comp", "sig", "text", some.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("minor"), F.lit(False).alias("other"))
    second = m.select("key", "_row", "comp", "sig", "text", F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("i"), mine.alias("j"), F.lit(False).alias("minor"), F.lit(True).alias("other"))
    return first.unionByName(second).groupBy("key", "i", "j").applyInArrow(_crossing(similarity), "a long, b long").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each input row: ``_row, root, _id, _h, _raw, class_id, class_size``.

    A class is a connected component of the links between texts whose distinct
    shingles (words with A-Z in lower case) have Jaccard similarity ``similarity`` or
    more; equal texts are one node. ``class_id`` is the smallest identifier of the class
    (null only if all are). Texts without words have no shingles: they form classes of
    equal texts only, null and empty ones being equal. Texts of fewer words than a
    shingle are one shingle. Rows with equal identifiers are rows of their own. However
    often shingles are repeated, the chance that a link at exactly 0.8 shares no band is
    0.00006.
    """
    h1, h2 = two_hashes(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(id_order(id_col).alias("_id"), text_id(text_col).alias("_h"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("text"))
    signed = cut(rows.mapInArrow(_signed, "_id long, _h long, h1 long, h2 long, sig binary").withColumn("_row", F.monotonically_increasing_id()), "signed")
    copies = cut(first_in_order(signed.select("h1", "h2", "_id", "_row"), ["h1", "h2"], ["_id", "_row"], label="copies").select(
        "_id", "_row", F.col("first__row").alias("node")), "copies")
    nodes = cut(signed.join(copies.where("_row = node").select("_row").hint("shuffle_hash"), "_row", "left_semi").where("sig IS NOT NULL"), "nodes")
    bands = nodes.select("_id", "_row", "sig").mapInArrow(_banded, "key long, _id long, _row long")
    led = cut(first_in_order(bands, ["key"], ["_id", "_row"], label="bands").where("_row <> first__row").select("key", F.col("first__row").alias("a"), F.col("_row").alias("b")), "led")
    shared = led.select(F.col("a").alias("_row")).union(led.select("b")).distinct()
    named = cut(nodes.select("_row", "_id", "_h").join(shared, "_row"), "named")
    texts = cut(rows.select("_id", "_h", "text").join(named.hint("shuffle_hash"), ["_id", "_h"]).select("_row", "text").dropDuplicates(["_row"]), "texts")
    links = _links(led.select("a", "b").distinct(), nodes, texts, similarity)
    roots = components(links)
    of = lambda side: salted_join(
        led, roots.select(F.col("u").alias(side), F.col("p").alias("comp")), [side], "left", F.col("b")).select("key", "a", "b", F.coalesce("comp", side).alias("comp"))
    sides = of("b").select("key", F.col("b").alias("_row"), "comp").union(of("a").select("key", F.col("a").alias("_row"), "comp").distinct())
    mixed = sides.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    members = cut(salted_join(sides, mixed, ["key"], spread=F.col("_row")), "mixed")
    if not members.isEmpty():
        roots = components(links.union(cut(_across(members, nodes, texts, similarity), "across")))
    joined = salted_join(copies, roots.select(F.col("u").alias("node"), F.col("p").alias("root")), ["node"], "left", F.col("_row"))
    labelled = cut(joined.select("_row", "_id", F.coalesce("root", "node").alias("root")), "labelled")
    sizes = labelled.groupBy("root").agg(F.min("_id").alias("class_id"), F.count("*").alias("class_size"))
    out = salted_join(labelled, sizes, ["root"], spread=F.col("_row")).select("_row", "root", "class_id", "class_size")
    raw = lambda c: F.when(F.col(c) == LAST_ID, F.lit(None)).otherwise(F.col(c))
    return signed.select("_row", "_id", "_h").join(out, "_row").select("_row", "root", "_id", "_h", raw("_id").alias("_raw"), raw("class_id").alias("class_id"), "class_size")


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest identifier.

    Equal rows and rows with equal identifiers are members like all others. The rows to
    keep are named by identifier and text, and a row that stands several times by both is
    kept once.
    """
    found = classes(docs, id_col, text_col, similarity)
    first = found.groupBy("root").agg(F.min(F.struct("_id", "_row", "_h")).alias("m")).select("m._id", "m._h")
    rows = packed(docs, id_order(id_col).alias("_id"), text_id(text_col).alias("_h"))
    kept = rows.join(first.hint("shuffle_hash"), ["_id", "_h"])
    again = found.groupBy("_id", "_h").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_h")
    twice = again.isEmpty()
    return unpacked(kept if twice else kept.dropDuplicates(["_id", "_h"]), docs)
