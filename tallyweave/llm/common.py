"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyweave.operators.ranking import dealt_by_range, places
from tallyweave.session import work_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as a set of characters.
BLANKS = " \t\n\x0b\x0c\r"
#: Ordering value of a null identifier: after all others.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_order(column: str | Column = "doc_id") -> Column:
    """Identifier as a long that sorts nulls last."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("long"), F.lit(LAST_ID))


def running(df: DataFrame, keys: list[str], order: list[str], sums: list[str], label: str = "running") -> DataFrame:
    """``df`` with ``before_<x>`` and ``same_<x>`` of each long ``x``: see ``ranking.places``."""
    return places(df, keys, order, sums, label)


def first_in_order(df: DataFrame, keys: list[str], order: list[str], label: str = "first") -> DataFrame:
    """``df`` with ``first_<x>`` for each ``order`` column: the values of the key's first row.

    The rows lie in ranges of (keys, order). Inside a range the first row is
    streamed along the sorted rows. Only the first key of a range can have begun
    in an earlier one, so those keys, one for each range at most, are looked up
    again and broadcast.
    """
    dealt = dealt_by_range(df, *keys, *order, label=label)
    stream = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = dealt.select("*", F.first(F.struct(*order)).over(stream).alias("_here"))
    heads = dealt.groupBy("_part").agg(F.min(F.struct(*keys)).alias("_h")).select(F.col("_h.*")).distinct()
    heads = heads.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    carried = (
        dealt.join(F.broadcast(heads), match)
        .groupBy(*[f"_k_{k}" for k in keys])
        .agg(F.min(F.struct(*order)).alias("_there"))
    )
    out = local.join(F.broadcast(carried), match, "left")
    found = F.coalesce(F.col("_there"), F.col("_here"))
    return out.select(*df.columns, *[found[o].alias(f"first_{o}") for o in order])


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", spread: Column | None = None, salts: int = 8) -> DataFrame:
    """Join on ``on`` where a few keys may fill much of ``left``; ``right`` has one row for each key.

    Rows of the left side are dealt over ``salts`` places by ``spread``; the right
    side is copied to each place.
    """
    salt = F.pmod(F.xxhash64(*([spread] if spread is not None else [F.rand(7)])), F.lit(salts)).cast("int")
    l = left.withColumn("_salt", salt)
    r = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return l.join(r, [*on, "_salt"], how).drop("_salt")


def two_hashes(column: str | Column) -> list[Column]:
    """Two independent 64-bit hashes of a text: equal only for equal texts, for all practical purposes."""
    c = F.col(column) if isinstance(column, str) else column
    return [F.xxhash64(c), F.xxhash64(F.lit("second"), c)]


def text_id(column: str = "text") -> Column:
    """Tells rows apart that share an identifier; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` as one column ``_doc``, whatever its columns are called, and ``more`` beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *more)


def unpacked(df: DataFrame, docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``docs`` from ``_doc``, and ``more``."""
    return df.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], *more)


def without(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows named in ``drop`` (``_id`` with nulls as the largest long, ``_h`` the text's hash).

    The short side is built into a hash table, so the texts are moved but not sorted.
    """
    left = packed(docs, id_order(id_col).alias("_id"), text_id(text_col).alias("_h"))
    return unpacked(left.join(drop.select("_id", "_h").hint("shuffle_hash"), ["_id", "_h"], "left_anti"), docs)


def path_of(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    import uuid

    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """pyarrow file system and plain path of a shared folder, for use inside tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def batches_by_bytes(batch, column: int, limit: int) -> Iterator:
    """Slices of an Arrow batch whose ``column`` holds about ``limit`` bytes each; one long row stays whole."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)
