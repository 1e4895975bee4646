"""Quality rules: base statistics of a text, and line frequency across the documents of a host.

Each task reads whole texts and returns numbers and line hashes. A line's
frequency is the number of distinct texts of the host that hold it. Lines above
the limit are removed from all documents but the host's first; a document of
which too little is left is rejected. ``judge`` gives the figures, ``cleaned`` the
kept documents without those lines.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from tallyweave.llm.common import BLANKS, id_order, packed, salted_join, text_id, unpacked
from tallyweave.session import cut

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate of its host above this many distinct texts, and above this share of them.
LINE_DOCS = 20
LINE_SHARE = 0.01
#: A document is depleted below this many words left, or below this share of its words.
LEFT_WORDS = 10
LEFT_SHARE = 0.3
WINDOW = 5

_LINE = pa.struct([("hash", pa.int64()), ("words", pa.int64())])
_OUT = pa.schema([
    ("_id", pa.int64()), ("_raw", pa.int64()), ("_host", pa.string()), ("_h", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("lines", pa.list_(_LINE))])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, overlaps included.

    Equal hashes only select the windows to look at; these are then compared as they are.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    single = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = single[:n].copy()
    for k in range(1, window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + single[k:k + n]
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    twin = ranked[1:] == ranked[:-1]
    if not twin.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][twin]] = True
    maybe[order[:-1][twin]] = True
    at = np.flatnonzero(maybe).tolist()
    found = [tuple(words[i:i + window]) for i in at]
    counts = Counter(found)
    cover = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, found, strict=True):
        if counts[w] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def line_key(line: str) -> tuple[int, int] | None:
    """Hash of a line in lower case with single spaces, and its words; None for a blank line."""
    bare = line.strip(BLANKS)
    if not bare:
        return None
    parts = bare.lower().encode("utf-8", "surrogatepass").split()
    return xxhash.xxh3_64_intdigest(b" ".join(parts)) - (1 << 63), len(parts)


def without_lines(text: str, gone: set[int]) -> str:
    """``text`` without the lines whose hash is in ``gone``, the others in order."""
    keys = [(line, line_key(line)) for line in text.split("\n")]
    return "\n".join(line for line, key in keys if key is None or key[0] not in gone)


@F.pandas_udf(StringType())
def _without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else without_lines(t, set(g)) for t, g in zip(text, gone, strict=True)], dtype=object)


def measure(text: str | None) -> tuple:
    """Statistics of one text, and its distinct normalised lines as (hash, words on all its copies)."""
    if not text:
        return 0, 0, 0, 0, 0, []
    words = text.encode("utf-8", "surrogatepass").split()
    blanks = sum(text.count(c) for c in BLANKS)
    seen: set[str] = set()
    lines: dict[int, int] = {}
    dups = 0
    for line in text.split("\n"):
        found = line_key(line)
        if found is None:
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        lines[found[0]] = lines.get(found[0], 0) + found[1]
    return len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), dups, repeated_words(words), list(lines.items())


def _measured(batches):
    for batch in batches:
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        flat = [pair for line in columns[5] for pair in line]
        ends = np.cumsum([0, *map(len, columns[5])], dtype=np.int32)
        pairs = pa.StructArray.from_arrays([pa.array([h for h, _ in flat], pa.int64()), pa.array([w for _, w in flat], pa.int64())], fields=list(_LINE))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("_id", "_raw", "_host", "_h")] + [pa.array(c, pa.int64()) for c in columns[:5]]
            + [pa.ListArray.from_arrays(pa.array(ends), pairs)], schema=_OUT)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS,
          line_share: float = LINE_SHARE, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE) -> DataFrame:
    """One row for each input row: ``_id, _raw, _h`` (identifier and text hash), the statistics,
    ``removed_words, base_failed, kept``, and ``_host`` and ``gone``, the hashes of the removed lines (null if none are).

    A null or empty text has no words and fails. Null hosts are one host. Equal texts
    count once in a line's frequency, so copies don't make their lines boilerplate. The
    first document of a host (smallest identifier, nulls last) keeps its lines, so
    boilerplate and groups of near copies stay in the corpus once. Rows with equal
    identifiers are judged one by one. An empty table gives no rows.
    """
    spec = "_id long, _raw long, _host string, _h long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<hash:long,words:long>>"
    rows = docs.select(
        id_order(id_col).alias("_id"), F.col(id_col).cast("long").alias("_raw"), F.col(host_col).cast("string").alias("_host"),
        text_id(text_col).alias("_h"), F.col(text_col).alias("text"))
    stats = cut(rows.mapInArrow(_measured, spec).withColumn("_row", F.monotonically_increasing_id()), "stats")
    hosts = stats.select("_host", "_h").groupBy("_host").agg(F.count_distinct("_h").alias("texts"))
    held = stats.select("_row", "_host", "_h", "_id", F.explode("lines").alias("l")).select("_row", "_host", "_h", "_id", "l.hash", "l.words")
    per_text = held.groupBy("_host", "hash", "_h").agg(F.min("_id").alias("_id"))
    often = per_text.groupBy("_host", "hash").agg(F.count("*").alias("n"), F.min("_id").alias("first")).where(F.col("n") > line_docs)
    over = often.join(hosts.withColumnRenamed("_host", "_name"), F.col("_host").eqNullSafe(F.col("_name")))
    over = cut(over.where(F.col("n") > F.col("texts") * F.lit(line_share)).select(F.coalesce("_host", F.lit("")).alias("_hk"), F.col("_host").isNull().alias("_hn"), "hash", "first"), "lines")
    keyed = held.select("_row", "_id", "hash", "words", F.coalesce("_host", F.lit("")).alias("_hk"), F.col("_host").isNull().alias("_hn"))
    hits = salted_join(keyed, over, ["_hk", "_hn", "hash"], spread=F.col("_row")).where(F.col("_id") > F.col("first"))
    removed = hits.groupBy("_row").agg(F.sum("words").alias("removed_words"), F.collect_list("hash").alias("gone"))
    judged = stats.drop("lines").join(removed, "_row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("removed_words") > 0) & ((left < left_words) | (left < F.col("n_words") * F.lit(left_share)))
    return judged.select(
        "_id", "_raw", "_h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "_host", "gone")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, their text without the removed lines.

    The lines that stay are as they were and in order. A kept text has ``n_words -
    removed_words`` words. Rows that are neither rejected nor changed pass as they are:
    only the others' names are joined.
    """
    judged = judge(docs, id_col, text_col, host_col, **limits)
    name = F.coalesce("_host", F.lit("")).alias("_hk"), F.col("_host").isNull().alias("_hn")
    change = judged.where("NOT kept OR gone IS NOT NULL").select("_id", "_h", *name, "kept", "gone").dropDuplicates(["_id", "_h", "_hk", "_hn"])
    host = F.col(host_col).cast("string")
    rows = packed(docs, id_order(id_col).alias("_id"), text_id(text_col).alias("_h"), F.coalesce(host, F.lit("")).alias("_hk"), host.isNull().alias("_hn"))
    left = rows.join(change.hint("shuffle_hash"), ["_id", "_h", "_hk", "_hn"], "left").where("coalesce(kept, true)")
    text = F.col("_doc").getField(text_col)
    fresh = left.select("_doc", _without_lines(F.when(F.col("gone").isNotNull(), text), "gone").alias("_fresh"))
    return unpacked(fresh.withColumn("_doc", F.col("_doc").withField(f"`{text_col}`", F.coalesce("_fresh", text))), docs)
