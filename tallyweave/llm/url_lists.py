"""URL filters as of the fetch time.

Dated entries of block lists (added, removed) become validity intervals of a host
or domain. A capture is held against the entries that were active on the day it was
fetched: its host and every parent domain meet the intervals of the same name and
month, and the day decides. Captures are joined as distinct (host, day), so a host
with a third of all captures costs no more than its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave.llm.common import packed, salted_join, unpacked
from tallyweave.session import cut

ADD, REMOVE = "add", "remove"


def host_of(url: str | Column) -> Column:
    """Lower-case host of an http(s) URL, null where there is none."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(F.lower(c), r"^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", F.rtrim(host, F.lit(".")))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, down to the last label."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def intervals(entries: DataFrame, list_col: str = "list", entry_col: str = "entry", day_col: str = "day", action_col: str = "action") -> DataFrame:
    """Validity of each list entry: ``list, entry, since, until`` (``until`` is not part of it; null: still valid).

    An entry is valid from a day on which it is added to the day before the next on which
    it is removed. Of several events of a day an addition wins; repeated additions don't
    start anew; events without entry, day or action are ignored, and a null list is the
    list ''.
    """
    events = entries.select(
        F.coalesce(F.col(list_col), F.lit("")).alias("list"), F.rtrim(F.lower(F.col(entry_col)), F.lit(".")).alias("entry"), F.col(day_col).cast("date").alias("day"),
        (F.col(action_col) == ADD).alias("on")).dropna(subset=["entry", "day", "on"])
    daily = events.groupBy("list", "entry", "day").agg(F.max("on").alias("on"))
    w = W.partitionBy("list", "entry").orderBy("day")
    turns = daily.withColumn("was", F.lag("on", 1, False).over(w)).where(F.col("on") != F.col("was"))
    spans = turns.withColumn("until", F.lead("day").over(w)).where("on")
    return spans.select("list", "entry", F.col("day").alias("since"), "until")


def as_of(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """``captures`` with ``host, blocked, n_entries, lists, listed_since``; one row for each input row.

    ``lists`` are the names of the lists with an active entry, sorted; ``listed_since``
    is the first day of the oldest of these entries. A capture without host or day is
    never blocked. Equal captures have equal results.
    """
    valid = cut(intervals(entries), "intervals")
    rows = packed(captures, host_of(url_col).alias("_host"), F.col(day_col).cast("date").alias("_day"))
    asked = cut(rows.select("_host", "_day").dropna().distinct(), "asked")
    last = asked.agg(F.max("_day").alias("d")).first()["d"]
    months = valid.where(F.col("since") <= F.lit(last)).withColumn(
        "month", F.explode(F.sequence(_month(F.col("since")), F.greatest(_month(F.col("since")), _month(F.coalesce(F.least("until", F.lit(last)), F.lit(last)))))))
    names = asked.select("_host", "_day", F.explode(suffixes(F.col("_host"))).alias("entry"), _month(F.col("_day")).alias("month"))
    active = names.join(months, ["entry", "month"]).where((F.col("since") <= F.col("_day")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))))
    found = cut(active.groupBy("_host", "_day").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("since").alias("listed_since")), "listed")
    out = salted_join(rows, found, ["_host", "_day"], "left")
    return unpacked(
        out, captures, F.col("_host").alias("host"), F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"), "listed_since")
