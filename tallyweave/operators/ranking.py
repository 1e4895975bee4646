"""Ranks and running totals inside a key group without one task holding the group.

A plain window over a hot key sorts the whole group in one task. Here the rows are
dealt into ranges of (keys, order), so a group of any size spans several ranges. Each
range is summed on its own; the ranges' totals, one row for each key and range, are
summed in order. There is one plan for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave.session import cut


def dealt_by_range(df: DataFrame, *order: Column | str, label: str = "ranges") -> DataFrame:
    """``df`` cut into ranges of ``order``, written, with the range number in ``_part``.

    A key that fills many rows spans several ranges as long as ``order`` goes on
    after it. Written once, because the number of a range must not change when a task
    is repeated.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), label)


def places(df: DataFrame, keys: list[str], order: list[str], sums: list[str], label: str = "running") -> DataFrame:
    """``df`` with ``before_<x>``: the sum of each long or decimal ``x`` over the key's rows that come earlier in ``order``.

    Rows equal in ``order`` count as one place: none of them is before the other;
    ``same_<x>`` is the sum over that place.
    """
    dealt = dealt_by_range(df, *keys, *order, label=label)
    totals = dealt.groupBy("_part", *keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("_part", *keys, *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in sums])
    upto = W.partitionBy("_part", *keys).orderBy(*order).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("_part", *keys, *order)
    local = dealt.select("*", *[F.sum(s).over(upto).alias(f"_l_{s}") for s in sums], *[F.sum(s).over(same).alias(f"same_{s}") for s in sums])
    on = ["_part", *keys]
    base = base.select(*[F.col(k).alias(f"_k_{k}") for k in on], *[f"_b_{s}" for s in sums])
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on]
    out = local.join(base, match)
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"_l_{s}") - F.col(f"same_{s}") + F.col(f"_b_{s}"))
    return out.drop("_part", *[f"_k_{k}" for k in on], *[f"_b_{s}" for s in sums], *[f"_l_{s}" for s in sums])


def ranked(df: DataFrame, keys: list[str], order: str, out: str = "pos") -> DataFrame:
    """1-based rank of each row in its key group; ``order`` is unique inside a group."""
    one = places(df.withColumn("_one", F.lit(1).cast("long")), keys, [order], ["_one"], label="ranks")
    return one.withColumn(out, F.col("before__one") + 1).drop("_one", "before__one", "same__one")


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """For each row the totals of ``sums`` over the group's rows with a smaller ``order``.

    Rows that share an order value see the same totals. Values must be longs or decimals;
    nulls count as nothing.
    """
    valued = df.select("*", *[F.coalesce(v, F.lit(0)).alias(f"_v_{n}") for n, v in sums.items()])
    summed = places(valued, keys, [order], [f"_v_{n}" for n in sums])
    return summed.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"before__v_{n}").alias(n) for n in sums])
