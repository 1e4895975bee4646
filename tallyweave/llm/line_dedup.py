"""Line dedup across documents, by first occurrence.

Lines become 128-bit hashes of their keys, dealt into ranges of (hash, document,
position); along the sorted ranges the first document of each hash is streamed.
What comes back is a run-length compressed keep bitmap for each document, not its
text. A line that a third of all documents hold spans many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave.llm.common import BLANKS, first_in_order, id_order, packed, text_id, two_hashes, unpacked
from tallyweave.session import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row for each document that loses lines: ``_id, _h, n_dropped, dropped``.

    ``_id`` is the identifier with nulls as the largest long; ``_h`` tells rows with
    the same identifier and other texts apart. ``dropped`` is the keep bitmap in
    compressed form: its runs of zeros in ascending order, as (start, length) of lines
    counted from 0. All other lines are ones.

    Null and empty texts are one empty line and lose nothing. Rows that share an
    identifier are one document: they don't make each other's lines repeat. Equal rows
    share one bitmap.
    """
    rows = docs.select(id_order(id_col).alias("_id"), text_id(text_col).alias("_h"), F.col(text_col).alias("_text"))
    lines = rows.select("_id", "_h", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    keyed = lines.select("_id", "_h", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    k1, k2 = two_hashes("key")
    occurrences = cut(keyed.select(k1.alias("k1"), k2.alias("k2"), "_id", "_h", "pos"), "lines")
    streamed = first_in_order(occurrences, ["k1", "k2"], ["_id", "pos"], label="lines")
    later = streamed.where(F.col("_id") > F.col("first__id")).select("_id", "_h", "pos").distinct()
    doc = ["_id", "_h"]
    run = (F.col("pos") - F.row_number().over(W.partitionBy(*doc).orderBy("pos"))).alias("run")
    runs = later.select(*doc, "pos", run).groupBy(*doc, "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
    return runs.groupBy(*doc).agg(
        F.sum("length").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("dropped"))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The array of lines that a bitmap keeps."""
    ends = F.concat(dropped, F.array(F.struct(F.size(lines).alias("start"), F.lit(0).alias("length"))))

    def piece(run, i):
        before = F.when(i == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(i, F.lit(1)))["start"] + F.element_at(ends, F.greatest(i, F.lit(1)))["length"])
        return F.slice(lines, before + 1, run["start"] - before)

    return F.flatten(F.transform(ends, piece))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; one row for each input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = packed(docs, id_order(id_col).alias("_id"), text_id(text_col).alias("_h"), text.alias("_text"))
    joined = left.join(bitmaps.select("_id", "_h", "n_dropped", "dropped").hint("shuffle_hash"), ["_id", "_h"], "left")
    lines, whole = F.split("_text", "\n"), F.col("_text")
    kept = F.when(F.col("dropped").isNull(), whole).otherwise(F.array_join(kept_lines(lines, F.col("dropped")), "\n"))
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return unpacked(joined, docs, n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
