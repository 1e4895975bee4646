"""Benchmark decontamination with a distributed positional inverted index.

The index is stored in segments, one for each slice of documents, like the shards
of a search engine: for every term of the tests, the sorted positions where the
segment's documents hold it. Searches run segment by segment from the index alone:
a phrase's lists are shifted by their offsets and intersected from the rarest term
on. Nothing is shuffled; a term that all documents hold is one more list in each
segment. ``hits`` gives exact phrase matches, ``near_hits`` proximity matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm.common import batches_by_bytes
from tallyweave.session import cut

WINDOW = 13
#: A proximity match holds this share of a window's distinct words within so many document words.
SPAN = 16
SHARE = 0.9
#: Text bytes in a segment, about; a longer document is a segment of its own.
SEGMENT_BYTES = 8 << 20
#: Tests are searched in blocks of at most this many items and text bytes, which is what a broadcast holds.
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 32 << 20

#: A-Z in lower case; all other ASCII but digits and letters parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def packed_positions(positions: np.ndarray) -> bytes:
    """Sorted positions as gaps, in the fewest bytes each that hold the largest gap."""
    gaps = np.diff(positions, prepend=0)
    top = int(gaps.max())
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        if top <= np.iinfo(kind).max:
            return bytes([np.dtype(kind).itemsize]) + gaps.astype(kind).astype(f"<u{np.dtype(kind).itemsize}").tobytes()
    raise ValueError("positions out of range")


def positions_in(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64))


def build_segment(texts: list[str | None], terms: dict[bytes, int]) -> dict:
    """Postings of one slice. Documents follow each other with a free position between, so no phrase spans two."""
    ids: list[np.ndarray] = []
    lengths = []
    gap = np.array([-1], np.int64)
    get = terms.get
    for t in texts:
        words = words_of(t)
        lengths.append(len(words))
        ids.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
        ids.append(gap)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    at = np.flatnonzero(flat >= 0)
    held = flat[at]
    order = np.argsort(held, kind="stable")
    held, at = held[order], at[order]
    cuts = np.flatnonzero(np.diff(held)) + 1
    starts = np.concatenate([[0], cuts]) if len(held) else np.zeros(0, np.int64)
    ends = np.concatenate([cuts, [len(held)]]) if len(held) else np.zeros(0, np.int64)
    return {
        "lengths": lengths,
        "terms": [int(held[s]) for s in starts],
        "postings": [packed_positions(at[s:e]) for s, e in zip(starts, ends, strict=True)],
    }


class Segment:
    """Searches in one stored segment."""

    def __init__(self, lengths: list[int], terms: list[int], postings: list[bytes]):
        self.lengths = np.asarray(lengths, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1].astype(np.int64)
        self.size = int((self.lengths + 1).sum())
        self._stored = dict(zip(terms, postings, strict=True))
        self._open: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray | None:
        if term not in self._open:
            data = self._stored.get(term)
            if data is None:
                return None
            self._open[term] = positions_in(data)
        return self._open[term]

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Start positions of the exact phrase."""
        lists = [self.positions(t) for t in terms]
        if any(x is None for x in lists):
            return np.zeros(0, np.int64)
        order = sorted(range(len(terms)), key=lambda i: len(lists[i]))
        starts = lists[order[0]] - order[0]
        for i in order[1:]:
            if not len(starts):
                break
            other, want = lists[i], starts + i
            place = np.searchsorted(other, want)
            starts = starts[(place < len(other)) & (other[np.minimum(place, len(other) - 1)] == want)]
        return starts

    def documents(self, positions: np.ndarray) -> np.ndarray:
        """Document number of each position."""
        return np.searchsorted(self.begins, positions, "right") - 1

    def near(self, terms: list[int], span: int) -> np.ndarray:
        """Documents in which all ``terms`` stand, in any order, within ``span`` words of the rarest one."""
        lists = [self.positions(t) for t in set(terms)]
        if any(x is None for x in lists):
            return np.zeros(0, np.int64)
        lists.sort(key=len)
        pivot = lists[0]
        docs = self.documents(pivot)
        ok = np.ones(len(pivot), bool)
        for other in lists[1:]:
            low = np.maximum(pivot - span, self.begins[docs])
            high = np.minimum(pivot + span, self.begins[docs] + self.lengths[docs] - 1)
            ok &= np.searchsorted(other, high, "right") > np.searchsorted(other, low, "left")
        return np.unique(docs[ok])

    def stretches(self, terms: list[int], span: int, share: float) -> list[tuple[int, int]]:
        """Shortest stretches (start, end) of at most ``span`` words of one document with ``share`` of the distinct ``terms``, in any order.

        No stretch lies in another. Each holds one of the rarest terms, as fewer may be
        missing: only places near those are looked at.
        """
        wanted = list(dict.fromkeys(terms))
        need = max(1, math.ceil(share * len(wanted) - 1e-9))
        lists = sorted((x for x in map(self.positions, wanted) if x is not None), key=len)
        spare = len(lists) - need
        if spare < 0:
            return []
        pivot = np.unique(np.concatenate(lists[:spare + 1]))
        missed = np.zeros(len(pivot), np.int64)
        for x in lists:
            missed += np.searchsorted(x, pivot + span - 1, "right") == np.searchsorted(x, pivot - span + 1, "left")
            keep = missed <= spare
            pivot, missed = pivot[keep], missed[keep]
            if not len(pivot):
                return []
        # The places near the pivots that are left, each once, with the number of the term there.
        near, which = [], []
        for k, x in enumerate(lists):
            at = np.searchsorted(pivot, x - span + 1, "left")
            ok = (at < len(pivot)) & (pivot[np.minimum(at, len(pivot) - 1)] <= x + span - 1)
            near.append(x[ok])
            which.append(np.full(int(ok.sum()), k))
        places, kinds = np.concatenate(near), np.concatenate(which)
        order = np.argsort(places)
        places, kinds = places[order].tolist(), kinds[order].tolist()
        docs = self.documents(np.array(places)).tolist()
        out: list[tuple[int, int]] = []
        held = [0] * len(lists)
        distinct = low = 0
        for high, place in enumerate(places):
            held[kinds[high]] += 1
            distinct += held[kinds[high]] == 1
            # Leave what is too far off or in another document, then what the stretch doesn't need.
            while place - places[low] >= span or docs[low] != docs[high] or distinct > need or held[kinds[low]] > 1:
                held[kinds[low]] -= 1
                distinct -= held[kinds[low]] == 0
                low += 1
            if distinct == need:
                if out and out[-1][0] == places[low]:
                    continue
                out.append((places[low], place + 1))
        return out


def _windows(items: list[tuple[str, list[int]]], window: int) -> Iterator[tuple[int, list[int]]]:
    """Distinct windows of each item; an item of fewer words is one window."""
    for n, (_, terms) in enumerate(items):
        if not terms:
            continue
        for w in {tuple(terms[i:i + window]) for i in range(max(1, len(terms) - window + 1))}:
            yield n, list(w)


class Tests:
    """A block of test items as term numbers: what the tasks of one pass hold."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        self.terms: dict[bytes, int] = {}
        items = [(i, [self.terms.setdefault(w, len(self.terms)) for w in words_of(t)]) for i, t in rows]
        self.ids = [i for i, _ in items]
        self.windows = list(_windows(items, window))


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str | None]]]:
    """The test items in blocks of bounded size, in the order of an iterator over partitions."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["t"] or "")
        if held and (len(held) >= BLOCK_ITEMS or size + n > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    if held:
        yield held


_SEGMENT = "ids array<bigint>, hashes array<bigint>, lengths array<int>, terms array<int>, postings array<binary>"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("postings", pa.list_(pa.binary()))])


def build_index(docs: DataFrame, tests, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored index over all of ``docs``, of the terms that the broadcast ``tests`` name."""

    def build(batches):
        for batch in batches:
            for part in batches_by_bytes(batch, 2, SEGMENT_BYTES):
                seg = build_segment(part.column(2).to_pylist(), tests.value.terms)
                rows = {"ids": [part.column(0).to_pylist()], "hashes": [part.column(1).to_pylist()], **{k: [v] for k, v in seg.items()}}
                yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("t"))
    return cut(rows.mapInArrow(build, _SEGMENT), "index")


_FOUND = pa.schema([("_raw", pa.int64()), ("_h", pa.int64()), ("n_words", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def search_index(index: DataFrame, tests) -> DataFrame:
    """For each document ``_raw, _h, n_words``, the hit word ranges as (start, end), and the items found."""

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row["lengths"], row["terms"], row["postings"])
                found: dict[int, tuple[list, set]] = {}
                for n, terms in tests.value.windows:
                    starts = seg.phrase(terms)
                    if len(starts):
                        docs = seg.documents(starts)
                        for d, s in zip(docs.tolist(), (starts - seg.begins[docs]).tolist(), strict=True):
                            spans, items = found.setdefault(d, ([], set()))
                            spans.append((s, s + len(terms)))
                            if tests.value.ids[n] is not None:
                                items.add(tests.value.ids[n])
                count = len(row["ids"])
                spans = [[{"start": s, "end": e} for s, e in _merged(found[d][0])] if d in found else [] for d in range(count)]
                items = [sorted(found[d][1]) if d in found else [] for d in range(count)]
                yield pa.RecordBatch.from_pydict({"_raw": row["ids"], "_h": row["hashes"], "n_words": row["lengths"], "spans": spans, "items": items}, schema=_FOUND)

    return index.mapInArrow(search, "_raw long, _h long, n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
         window: int = WINDOW) -> DataFrame:
    """One row for each input row: ``_raw, _h`` (identifier and text hash), ``n_words, n_hit, spans, items, contaminated``.

    ``spans`` are the ranges of document words inside an occurrence of any item's
    window, ``items`` the identifiers (as strings, sorted) of the items that occur.
    Null and empty texts, and texts without a word, have no words and no hits; items
    without words never occur; repeated item identifiers count once, and an item without
    identifier makes hits but isn't named; equal rows have
    equal results. Without items nothing is contaminated, without documents there are
    no rows.
    """
    spark: SparkSession = docs.sparkSession
    parts = []
    for block in blocks(benchmark, item_col, item_text):
        tests = spark.sparkContext.broadcast(Tests(block, window))
        parts.append(search_index(build_index(docs, tests, id_col, text_col), tests))
    if not parts:
        tests = spark.sparkContext.broadcast(Tests([], window))
        parts.append(search_index(build_index(docs, tests, id_col, text_col), tests))
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.groupBy("_raw", "_h").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / len(parts)).cast("int").alias("_n"))
        found = found.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    n_hit = F.when(F.size("spans") == 0, F.lit(0)).otherwise(F.size(hit)).cast("long")
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


_NEAR = pa.schema([("_raw", pa.int64()), ("_h", pa.int64()), ("item", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def search_near(index: DataFrame, tests, span: int = SPAN, share: float = SHARE) -> DataFrame:
    """Proximity matches of each document and item: ``_raw, _h, item, spans``."""

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row["lengths"], row["terms"], row["postings"])
                found: dict[tuple[int, str | None], set[tuple[int, int]]] = {}
                for n, terms in tests.value.windows:
                    for s, e in seg.stretches(terms, span, share):
                        d = int(seg.documents(np.array([s]))[0])
                        begin = int(seg.begins[d])
                        found.setdefault((d, tests.value.ids[n]), set()).add((s - begin, e - begin))
                yield pa.RecordBatch.from_pydict({
                    "_raw": [row["ids"][d] for d, _ in found], "_h": [row["hashes"][d] for d, _ in found], "item": [i for _, i in found],
                    "spans": [[{"start": s, "end": e} for s, e in sorted(x)] for x in found.values()]}, schema=_NEAR)

    return index.mapInArrow(search, "_raw long, _h long, item string, spans array<struct<start:bigint,end:bigint>>")


def near_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
              window: int = WINDOW, span: int = SPAN, share: float = SHARE) -> DataFrame:
    """One row for each document and item that match by proximity: ``_raw, _h, item, spans``.

    ``spans`` are the shortest ranges of at most ``span`` document words that hold
    ``share`` of the distinct words of one of the item's windows, in any order, so
    passages with an inserted or changed word are found as well. Equal rows of ``docs``
    are one document; items without identifier are one item.
    """
    spark: SparkSession = docs.sparkSession
    parts = []
    for block in blocks(benchmark, item_col, item_text):
        tests = spark.sparkContext.broadcast(Tests(block, window))
        parts.append(search_near(build_index(docs, tests, id_col, text_col), tests, span, share))
    if not parts:
        return spark.createDataFrame([], "_raw long, _h long, item string, spans array<struct<start:bigint,end:bigint>>")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("_raw", "_h", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
