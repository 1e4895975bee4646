"""Exclusive one-to-one assignment, equal to a greedy pass in id order.

The greedy rule: left rows go in id order; each takes its best right row that
is still free, best meaning lowest tier, then lowest right id. All right rows
prefer the earliest left row, so the result is the one stable matching and can
be reached by deferred acceptance instead of a sequential pass: every left row
proposes to its best row that has not refused it, a right row keeps the lowest
proposer and refuses all later ones, until nobody is refused. Refusals may
happen in any order, which is what lets the work be split.

Preferences are never expanded to pairs. Left rows with equal preferences share
a *list*, and a left row names its lists by tier:

* ``left_lists(left_id, tier, list_id)``, optionally with a text ``place``
* ``lists(list_id, right_id)``, read in right-id order

The j-th left row that starts on a list cannot get anything before position j (the j-1
earlier ones hold j-1 better entries), so it starts there: a list shared by any number
of left rows is handed out by rank. A chunk of left rows gets each list's entries once,
however many of its rows share the list: from where they start to where they would all
be served if nobody else took any, and a few more. Further entries, then further tiers,
are looked at only for rows all of whose entries refused them.

Left rows are cut into chunks of bounded size, in the order of their places, and a place that
is too crowded for one chunk in id order. Rows of one place compete with each other and few
with others; of a place's chunks the first is right after one round, the next after two, and
so on. Every other round the chunks are cut half a chunk further on, so that a refusal that
goes to and fro over a chunk's end stays inside the next one. Lists have numbers inside the
rounds. The rounds are semi-naive: the *frontier*
is made of the rows refused in the last round (and those whose windows are used up), and
only its chunks are looked at again. Inside a chunk its rows choose anew in id order, and
those of the chunk that they push out after them, so a refusal is followed through the whole
chunk at once. What is new in their choices is added to a log; nothing settled is ever
rewritten. A right row is held by the smallest
left row that ever proposed to it, so the places held are that minimum over the log, and
a candidate whose holder comes earlier has refused for good. So a round writes no more
than its proposals and its frontier. Chunking changes the number of rounds, never the
result: ``place`` only says which left rows are likely to compete.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyweave.operators.ranking import places, ranked, running
from tallyweave.session import cut, cut_path, many

BLOCK = 256  # list positions per join key
SPARE = 64  # entries of a list at hand beyond those that a chunk's own rows would take, doubled each time they are used up
DOUBLINGS = 12
NOBODY = int(np.iinfo(np.int64).max)
CHUNK = 50_000  # left rows per chunk
ROUND = "at long, left_id long, tier int, right_id long, list_id long, upto long"


def _positions(left_lists: DataFrame, chunk: int) -> DataFrame:
    """``left_id, at``: where a row stands among all; ``chunk`` positions make a chunk.

    Places stand in order, numbers by value, so that neighbours share a chunk. The rows of a
    place stand where it begins, unless they are more than a chunk; then they stand in id order.
    """
    place = F.col("place") if "place" in left_lists.columns else F.lit(None).cast("string")
    lefts = left_lists.groupBy("left_id").agg(F.coalesce(F.min(place), F.lit("")).alias("place"))
    lefts = lefts.withColumn("_number", F.col("place").try_cast("double")).withColumn("_one", F.lit(1).cast("long"))
    lefts = places(lefts, [], ["_number", "place", "left_id"], ["_one"], label="lefts")
    lefts = cut(lefts.select("left_id", "place", F.col("before__one").alias("_at")), "lefts")
    whole = lefts.groupBy("place").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    return lefts.join(many(whole), "place").select("left_id", F.when(F.col("_n") > chunk, F.col("_at")).otherwise(F.col("_first")).alias("at"))


def _cursors(left_lists: DataFrame, sizes: DataFrame, positions: DataFrame) -> DataFrame:
    """Where each left row starts on each of its lists, which have numbers from here on."""
    mine = left_lists.select("left_id", "tier", "list_id").join(many(sizes), "list_id").drop("list_id").withColumnRenamed("number", "list_id")
    per_left = W.partitionBy("left_id")
    mine = mine.withColumn("_first", F.min("tier").over(per_left))
    firsts = F.count_if(F.col("tier") == F.col("_first")).over(per_left)
    starts_here = ((F.col("tier") == F.col("_first")) & (firsts == 1)).cast("long")
    mine = mine.select("left_id", "tier", "list_id", "size", starts_here.alias("_s")).dropDuplicates(["left_id", "tier", "list_id"])
    mine = cut(mine.join(many(positions), "left_id"), "cursors")
    counted = running(mine, ["list_id"], "left_id", {"before": F.col("_s")})
    return cut(
        counted.select("left_id", "at", "tier", "list_id", "size", (F.col("before") + 1).cast("long").alias("next")), "cursors")


def _entries(cursors: DataFrame, lists: DataFrame, spare: int) -> DataFrame:
    """The list entries that each chunk needs: ``chunk, list_id, pos, right_id``.

    The i-th row of a chunk on a list, by start, would be served at ``i`` plus the largest
    lead of a start over its rank so far. Each row asks for the stretch from the place of
    the row before it (or its own start) to ``spare`` entries beyond its place, twice as many
    for each time that it has used up what it had of this list; together the stretches have
    no gap from any row's start to its place.
    """
    w = W.partitionBy("chunk", "list_id").orderBy("next", "left_id")
    ranks = cursors.where("next <= size").withColumn("_i", F.row_number().over(w))
    lead = F.max(F.col("next") - F.col("_i")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    beyond = spare * F.pow(F.lit(2), F.least("tries", F.lit(DOUBLINGS))).cast("long")
    asked = ranks.withColumn("_at", F.col("_i") + lead).select(
        "chunk", "list_id", F.greatest("next", F.col("_at") - 1).alias("lo"), F.least(F.col("_at") + beyond, "size").alias("hi")).where("lo <= hi")
    blocks = asked.withColumn("block", F.explode(F.sequence(F.floor((F.col("lo") - 1) / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))))
    need = blocks.groupBy("chunk", "list_id", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return need.join(lists, ["list_id", "block"]).where("pos BETWEEN lo AND hi").select("chunk", "list_id", "pos", "right_id")


def _propose(key: tuple, rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Within a chunk: its active left rows in id order, each its best entry that none before it took.

    A row of the chunk that loses its entry to an earlier one becomes active in turn. Returned
    are choices that are new, and, without a right row, how far the lists of those rows were
    read that found all entries at hand taken. Rows come in id order, for who is pushed out is
    later than who did it, so entries only ever close, and closed ones are jumped over for good.
    """
    rows = rows.sort_values(["left_id", "tier"], kind="stable")
    entries = entries.sort_values(["list_id", "pos"], kind="stable")
    names, codes = np.unique(np.r_[entries["list_id"].to_numpy(dtype=np.int64), rows["list_id"].to_numpy(dtype=np.int64)], return_inverse=True)
    of_entry, of_row = codes[:len(entries)], codes[len(entries):]
    pos, right = entries["pos"].to_numpy(), entries["right_id"].to_numpy()
    holder = entries["holder"].to_numpy(dtype=np.int64)
    begin, end = np.searchsorted(of_entry, np.arange(len(names))), np.searchsorted(of_entry, np.arange(len(names)), side="right")
    jump = np.arange(len(entries) + 1)
    taken: dict[int, int] = {}

    def first_open(i: int, stop: int, at: int, left: int) -> tuple[int, int]:
        """Index of the first open entry from ``i``, or -1, and the position up to which all are closed."""
        passed = []
        while i < stop and pos[i] == at:
            if jump[i] != i:
                passed.append(i)
                at, i = at + (jump[i] - i), jump[i]
            elif holder[i] < left or taken.get(right[i], NOBODY) < left:
                jump[i] = i + 1
            else:
                break
        for p in passed:
            jump[p] = i
        return (i, at) if i < stop and pos[i] == at else (-1, at)

    out: list[tuple] = []
    lefts, tiers, starts, sizes, stands = (rows[c].to_numpy() for c in ("left_id", "tier", "next", "size", "at"))
    ids, at_row = np.unique(lefts, return_index=True)
    begins, ends = dict(zip(ids, at_row, strict=True)), np.r_[at_row[1:], len(rows)]
    ends = dict(zip(ids, ends, strict=True))
    waiting = ids[rows["active"].to_numpy(dtype=bool)[at_row]].tolist()  # sorted, so a heap
    while waiting:
        left = heappop(waiting)
        k, last, best, sure, moved = begins[left], ends[left], -1, True, []
        while k < last and best < 0 and sure:
            tier, limit = tiers[k], None
            while k < last and tiers[k] == tier:
                c, at = of_row[k], starts[k]
                if at <= sizes[k]:
                    i = begin[c] + np.searchsorted(pos[begin[c]:end[c]], at)
                    i, at = first_open(i, end[c], at, left)
                    if i >= 0:
                        best = i if best < 0 or right[i] < right[best] else best
                    elif at <= sizes[k]:  # there are entries that are not at hand, all beyond the last one read
                        seen = begin[c] + np.searchsorted(pos[begin[c]:end[c]], at) - 1
                        bound = right[seen] if seen >= begin[c] else np.iinfo(np.int64).min
                        limit = bound if limit is None else min(limit, bound)
                        moved.append((stands[k], left, None, None, names[c], at))
                k += 1
            if limit is not None and (best < 0 or right[best] > limit):
                best, sure = -1, False
        if best >= 0:
            loser = min(holder[best], taken.get(right[best], NOBODY))
            taken[right[best]] = left
            if loser != left:
                out.append((stands[begins[left]], left, tier, right[best], None, None))
                if loser in begins:
                    heappush(waiting, int(loser))
        elif not sure:
            out += moved
    columns = list(zip(*out, strict=True)) or [()] * 6
    kinds = {"at": "int64", "left_id": "int64", "tier": "Int32", "right_id": "Int64", "list_id": "Int64", "upto": "Int64"}
    return pd.DataFrame({name: pd.array(list(values), dtype=kind) for (name, kind), values in zip(kinds.items(), columns, strict=True)})


class _Log:
    """Tables of one schema, written one by one and read together."""

    def __init__(self, spark: SparkSession, label: str, schema: str):
        self.spark, self.label, self.schema, self.parts = spark, label, schema, []

    def add(self, df: DataFrame) -> DataFrame:
        part, path = cut_path(df, self.label)
        self.parts.append(path)
        return part

    def proposals(self) -> DataFrame:
        return self._all().where("right_id IS NOT NULL").select("at", "left_id", "tier", "right_id")

    def moves(self) -> DataFrame:
        return self._all().where("right_id IS NULL").select("at", "left_id", "list_id", "upto")

    def _all(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.parts)


def _now(cursors: DataFrame, log: _Log, frontier: DataFrame | None, chunk: Column) -> DataFrame:
    """Cursors of the frontier's chunks, moved on where entries were used up."""
    cursors = cursors.withColumn("chunk", chunk)
    if frontier is None:
        return cursors.select("*", F.lit(0).alias("tries"), F.lit(True).alias("active"))
    chunks = frontier.select(chunk.alias("chunk")).distinct()
    mine = cursors.join(chunks, "chunk", "left_semi")
    moved = log.moves().withColumn("chunk", chunk).join(chunks, "chunk", "left_semi").groupBy("left_id", "list_id").agg(F.max("upto").alias("upto"), F.count("*").cast("int").alias("tries"))
    mine = mine.join(many(moved), ["left_id", "list_id"], "left").join(many(frontier.select("left_id", F.lit(True).alias("active"))), "left_id", "left")
    return mine.select(
        "left_id", "at", "chunk", "tier", "list_id", "size", F.coalesce("upto", "next").alias("next"), F.coalesce("tries", F.lit(0)).alias("tries"),
        F.coalesce("active", F.lit(False)).alias("active"))


def greedy_assign(
    left_lists: DataFrame, lists: DataFrame, max_rounds: int | None = None, chunk: int = CHUNK, trace: list[dict] | None = None,
    spare: int | None = None,
) -> DataFrame:
    """Matches ``left_id, right_id, tier``. Ids are longs, list ids texts; rows that repeat count once.

    ``max_rounds`` only guards tests against a loop that does not end; reaching
    it raises. Progress is sure: each round refuses or draws at least one row.
    ``trace`` receives the rows that each round wrote to the log and to its frontier.
    ``spare`` stands for ``SPARE`` where rows name many short lists that overlap.
    """
    spark = left_lists.sparkSession
    left_lists, lists = cut(left_lists, "left-lists"), cut(lists, "raw-lists")
    numbers = cut(lists.select("list_id").distinct().withColumn("number", F.monotonically_increasing_id()), "list-numbers")
    lists = lists.join(many(numbers), "list_id").select(F.col("number").alias("list_id"), "right_id").distinct()
    lists = cut(ranked(lists, ["list_id"], "right_id").withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)), "lists")
    sizes = numbers.join(many(lists.groupBy(F.col("list_id").alias("number")).agg(F.max("pos").alias("size"))), "number")
    cursors = _cursors(left_lists, sizes, _positions(left_lists, chunk))
    log, frontier, rounds = _Log(spark, "round", ROUND), None, 0
    while True:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        shift = 0 if rounds % 2 else chunk // 2
        now = _now(cursors, log, frontier, F.floor((F.col("at") + shift) / chunk).cast("long"))
        before = log.proposals().groupBy("right_id").agg(F.min(F.struct("left_id", "at")).alias("h")).select(
            "right_id", F.col("h.left_id").alias("holder"), F.col("h.at").alias("holder_at"))
        at_hand = _entries(now, lists, spare or SPARE).join(before.select("right_id", "holder"), "right_id", "left").na.fill({"holder": NOBODY})
        at_hand = at_hand.select(*[F.col(c).alias(c) for c in at_hand.columns])  # columns of their own, apart from those of ``now``
        new = log.add(now.groupBy("chunk").cogroup(at_hand.groupBy("chunk")).applyInPandas(_propose, ROUND))
        made = new.where("right_id IS NOT NULL").select("right_id", "left_id", "at", F.lit(True).alias("made"))
        rivals = made
        if frontier is not None:
            rivals = made.unionByName(before.join(made, "right_id", "left_semi").select(
                "right_id", F.col("holder").alias("left_id"), F.col("holder_at").alias("at"), F.lit(False).alias("made")))
        won = F.col("left_id") == F.min("left_id").over(W.partitionBy("right_id"))
        # a row that lost its entry and has another by now is not refused
        refused = rivals.withColumn("won", won).groupBy("left_id", "at").agg(
            F.bool_or(~F.col("won")).alias("lost"), F.bool_or(F.col("made") & F.col("won")).alias("served")).where("lost AND NOT served").select("left_id", "at")
        frontier = cut(refused.unionByName(new.where("right_id IS NULL").select("left_id", "at")).distinct(), "frontier")
        left = frontier.count()
        if trace is not None:
            trace.append({"log": new.count(), "frontier": left})
        if not left:
            final = log.proposals().groupBy("right_id").agg(F.min(F.struct("left_id", "tier")).alias("h"))
            return final.select(F.col("h.left_id").alias("left_id"), "right_id", F.col("h.tier").alias("tier"))
