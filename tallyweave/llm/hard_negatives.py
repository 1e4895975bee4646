"""Hard negatives of labelled vectors: best-first search of STR-packed R-trees.

Rows are tiled by sort-tile-recursive packing: by quantiles of the first coordinate into
slabs, by quantiles of the second into tiles, both found by Spark; a tile with more rows
than a tree holds (equal vectors, say) is dealt over several trees. Inside a tree the rows
are sorted and cut on along the widest coordinates down to leaves, and nodes over nodes
get minimum bounding boxes. Trees are rows of a table, as query blocks are; each pair of
them is one bounded piece of work, and the best of all trees are ranked by a window.

A box bounds the inner product with a query coordinate by coordinate (each coordinate's
product lies between those of the box's two ends). Each query has a queue of boxes by
their upper bound; the best ones are opened, those outside its score window or strictly
below its kth best are dropped. The queues of a block are worked off side by side, so a
leaf is multiplied with all queries that open it at once.

The first search looks for the positives of each anchor (same label), the second for the
rows of other labels inside the score window that each positive gives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave.llm.common import LAST_ID
from tallyweave.session import cut

POSITIVES, NEGATIVES = 5, 3
#: Share of a positive's score that a negative has at least and at most, in hundredths.
FROM_SHARE, UPTO_SHARE = 50, 95
SCALE = 256
LEAF, FANOUT = 128, 8
TREES, LEAST_TREE, MOST_TREE = 24, 2048, 65536  # trees wanted, and the rows one holds
QUERY_ROWS, SLICE = 8192, 512  # queries of a block, and those searched side by side
_TREE = "tree long, n long, dims int, kind string, vectors binary, ids binary, labels binary"
_LONG = np.iinfo(np.int64).max


def whole_rows(vectors: DataFrame) -> DataFrame:
    """``_row, _id, label, v``: the rows that take part, with whole components.

    Left out are rows with a null label or vector and those with a null or non-finite
    component, also one that is not finite when scaled. ``_row`` numbers the rows, so
    repeated ones stay apart. Null identifiers come last.
    """
    finite = "label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x) * 256) < double('infinity'))"
    base = vectors.select("vec_id", "label", "embedding").where(F.expr(finite))
    return base.select(
        F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.rint(F.floor(x.cast("double") * SCALE).cast("double"))).alias("v"))


def _tiled(rows: DataFrame, count: int, size: int) -> tuple[DataFrame, int]:
    """``rows`` with ``tree``, and the number of trees; none holds much more than ``size`` rows."""
    wanted = max(1, -(-count // size))
    slabs = int(np.ceil(np.sqrt(wanted)))
    runs = -(-wanted // slabs)
    # a vector without a component has 0 there
    part = lambda k: F.coalesce(F.try_element_at("v", F.lit(k)), F.lit(0.0))
    cuts = lambda n: F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else None
    place = lambda bounds, x: F.size(F.filter(bounds, lambda b: b < x)).cast("long")
    laid = rows.withColumn("_c1", part(1)).withColumn("_c2", part(2)).withColumn("_slab", F.lit(0).cast("long")).withColumn("_run", F.lit(0).cast("long"))
    if slabs > 1:
        # as many numbers as the square root of the trees
        bounds = laid.agg(F.percentile_approx("_c1", cuts(slabs), F.lit(10000))).first()[0]
        laid = laid.withColumn("_slab", place(F.array(*[F.lit(b) for b in bounds]), F.col("_c1")))
    if runs > 1:
        bounds = laid.groupBy("_slab").agg(F.percentile_approx("_c2", cuts(runs), F.lit(10000)).alias("_b2"))
        laid = laid.join(bounds, "_slab").withColumn("_run", place(F.col("_b2"), F.col("_c2"))).drop("_b2")
    laid = laid.withColumn("_tile", F.col("_slab") * runs + F.col("_run"))
    tiles = cut(laid.groupBy("_tile").agg(F.ceil(F.count("*") / F.lit(size)).cast("long").alias("_parts")), "tiles")
    # one row for each tile, of which there are as many as trees
    numbered = tiles.withColumn("_base", F.sum("_parts").over(W.orderBy("_tile")) - F.col("_parts"))
    dealt = laid.join(numbered, "_tile").withColumn("tree", F.col("_base") + F.pmod(F.xxhash64("_row"), F.col("_parts")))
    total = tiles.agg(F.sum("_parts")).first()[0] or 0
    return dealt.select("tree", "_row", "_id", "label", "v"), int(total)


def pack_order(v: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order of the rows of ``v``, along the coordinates that spread most."""
    wide = np.argsort(-(v.max(0) - v.min(0)), kind="stable") if len(v) else np.zeros(0, int)

    def tile(rows: np.ndarray, level: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or level == len(wide):
            return [rows]
        slabs = int(np.ceil(pages ** (1 / (len(wide) - level))))
        rows = rows[np.argsort(v[rows, wide[level]], kind="stable")]
        step = leaf * -(-pages // slabs)
        return [x for i in range(0, len(rows), step) for x in tile(rows[i:i + step], level + 1)]

    return np.concatenate(tile(np.arange(len(v)), 0)) if len(v) else np.zeros(0, int)


def _number_type(*arrays: np.ndarray) -> type:
    """The fastest type in which inner products of whole vectors are exact."""
    top = [float(np.abs(a).max()) if a.size else 0.0 for a in arrays]
    most = top[0] * top[-1] * max(1, arrays[0].shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _exact(a: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return np.ascontiguousarray(a, dtype=kind)
    out = np.empty(a.shape, object)
    out[...] = [[int(x) for x in row] for row in a.tolist()] if a.size else out
    return out


@dataclass
class Tree:
    """A packed tree: rows in leaf order, and the boxes of each level, leaves first."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray

    def __post_init__(self):
        low = np.minimum.reduceat(self.vectors, np.arange(0, len(self.vectors), LEAF))
        high = np.maximum.reduceat(self.vectors, np.arange(0, len(self.vectors), LEAF))
        self.levels = [(low, high)]
        while len(low) > FANOUT:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((low, high))

    def search(self, queries: np.ndarray, labels: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        """Best ``k`` rows of each query and window: arrays ``query, window, score, id``.

        ``low`` and ``high`` hold each query's windows of scores, both ends included. ``same``
        asks for rows of the query's label but not of its identifier, else for rows of
        other labels. Higher scores come first, ties by smaller identifier.
        """
        kind = _number_type(self.vectors, queries)
        bound_kind = np.float64 if kind is object else kind
        slack = 0 if kind is not object else 1e-9
        rows, q = _exact(self.vectors, kind), _exact(queries, kind)
        qf = queries.astype(bound_kind)
        up, down = np.maximum(qf, 0), np.minimum(qf, 0)

        def bounds(boxes):
            lo, hi = boxes[0].astype(bound_kind), boxes[1].astype(bound_kind)
            upper, lower = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
            return (upper + slack * np.abs(upper), lower - slack * np.abs(lower)) if slack else (upper, lower)

        n, windows = low.shape
        kth = low.astype(object if kind is object else np.float64)  # scores below it can't be among the best
        best: list[np.ndarray] = [np.zeros((0, 4), object if kind is object else np.int64)]

        def alive(upper, lower):
            """Query x box: some window that the box reaches."""
            out = np.zeros(upper.shape, bool)
            for w in range(windows):
                out |= (upper >= kth[:, w, None].astype(np.float64)) & (lower <= high[:, w, None].astype(np.float64)) & (low[:, w, None] <= high[:, w, None])
            return out

        # from the top level down, only children of boxes that are alive are queued
        open_ = np.ones((n, len(self.levels[-1][0])), bool)
        for level in range(len(self.levels) - 1, -1, -1):
            upper, lower = bounds(self.levels[level])
            open_ = open_[:, :upper.shape[1]] & alive(upper, lower)
            if level:
                open_ = np.repeat(open_, FANOUT, axis=1)
        queue = np.where(open_, upper, -np.inf)
        order = np.argsort(-queue, axis=1, kind="stable")
        at, width = 0, 1
        while at < order.shape[1]:
            picked = order[:, at:at + width]
            mine = np.repeat(np.arange(n), picked.shape[1])
            leaf = picked.ravel()
            top = queue[mine, leaf]
            reach = (top[:, None].astype(np.float64) >= kth[mine].astype(np.float64)).any(1) & (top > -np.inf)
            if not reach.any():
                break  # queues are in order of their upper bounds
            mine, leaf = mine[reach], leaf[reach]
            by = np.argsort(leaf, kind="stable")
            mine, leaf = mine[by], leaf[by]
            starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            for s, e in zip(starts, [*starts[1:], len(leaf)], strict=True):
                who, a = mine[s:e], leaf[s] * LEAF
                block = slice(a, min(a + LEAF, len(rows)))
                score = q[who] @ rows[block].T
                fits = labels[who][:, None] == self.labels[block][None, :]
                fits = fits & (ids[who][:, None] != self.ids[block][None, :]) if same else ~fits
                for w in range(windows):
                    hit = fits & (score >= kth[who, w][:, None]) & (score <= high[who, w][:, None])
                    x, y = np.nonzero(hit.astype(bool))
                    if len(x):
                        best.append(np.column_stack([c.astype(best[0].dtype) for c in (who[x], np.full(len(x), w), score[x, y], self.ids[block][y])]))
            best, kth = self._ranked(best, kth, k)
            at, width = at + width, width * 2
        return best[0]

    @staticmethod
    def _ranked(best, kth, k):
        """The best ``k`` of what was found so far, and the scores that later finds must reach."""
        found = np.concatenate(best)
        if len(found):
            order = np.lexsort((found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))
            found = found[order]
            group = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)])
            place = np.arange(len(found)) - np.repeat(group, np.diff(np.r_[group, len(found)]))
            full = found[place == k - 1]
            kth = kth.copy()
            kth[full[:, 0].astype(int), full[:, 1].astype(int)] = full[:, 2]
            found = found[place < k]
        return [found], kth


def _packed_vectors(vectors: list, dims: int) -> tuple[str, np.ndarray]:
    v = np.zeros((len(vectors), dims))
    for i, x in enumerate(vectors):
        v[i, :len(x)] = x
    return ("<i2" if not v.size or np.abs(v).max() < 2**15 else "<f8"), v


def _tree_maker(dims: int):
    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, v = _packed_vectors(table.column("v").to_pylist(), dims)
        ids, labels = np.asarray(table.column("_id"), np.int64), np.asarray(table.column("label"), np.int64)
        by = np.lexsort((np.asarray(table.column("_row")), ids))
        v, ids, labels = v[by], ids[by], labels[by]
        order = pack_order(v)
        return pa.table({
            "tree": [key[0].as_py()], "n": [len(v)], "dims": pa.array([dims], pa.int32()), "kind": [kind],
            "vectors": [v[order].astype(kind).tobytes()], "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()]})

    return make


@dataclass
class Forest:
    """Trees over a table of vectors, written once and searched by blocks of queries."""

    rows: DataFrame
    trees: DataFrame
    n_trees: int
    dims: int

    def best(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """The best ``k`` partners of each query and window, over all trees.

        ``queries`` has ``_row, _id, label, v`` and ``windows``, an array of ``(low, high)``.
        Returns ``_row, window`` (from 0), ``rank`` (from 1), ``score, id``.
        """
        dims = self.dims
        count = queries.count()
        blocks = max(1, -(-count // QUERY_ROWS))
        # queries are dealt over blocks, and each block goes to each tree: one row for each pair
        block = queries.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
        asked = block.groupBy("_block").applyInArrow(_query_maker(dims), "_block long, kind string, vectors binary, queries binary, ids binary, labels binary, low binary, high binary")
        asked = cut(asked, "query-blocks").select("_block", *[F.col(c).alias(f"q_{c}") for c in ("kind", "vectors", "queries", "ids", "labels", "low", "high")])
        pairs = asked.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, self.n_trees - 1)).cast("long"))))
        met = self.trees.join(pairs, "tree").groupBy("tree", "_block").applyInArrow(_searcher(k, same), "_row long, window int, score long, id long")
        place = F.row_number().over(W.partitionBy("_row", "window").orderBy(F.desc("score"), "id"))
        return met.withColumn("rank", place).where(F.col("rank") <= k)


def _query_maker(dims: int):
    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, v = _packed_vectors(table.column("v").to_pylist(), dims)
        windows = table.column("windows").to_pylist()
        wide = max(1, max(len(w) for w in windows))
        # a window that asks for nothing is upside down
        low, high = np.full((len(v), wide), 1, np.int64), np.zeros((len(v), wide), np.int64)
        for i, w in enumerate(windows):
            for j, x in enumerate(w):
                low[i, j], high[i, j] = x["low"], x["high"]
        raw = lambda c: np.asarray(table.column(c), np.int64).tobytes()
        return pa.table({
            "_block": [key[0].as_py()], "kind": [kind], "vectors": [v.astype(kind).tobytes()], "queries": [raw("_row")], "ids": [raw("_id")], "labels": [raw("label")],
            "low": [low.tobytes()], "high": [high.tobytes()]})

    return make


def _searcher(k: int, same: bool):
    def search(table: pa.Table) -> pa.Table:
        out = []
        for r in table.to_pylist():
            n, dims = r["n"], r["dims"]
            longs = lambda c: np.frombuffer(r[c], np.int64)  # noqa: B023, E731
            tree = Tree(np.frombuffer(r["vectors"], r["kind"]).reshape(n, dims).astype(np.float64), longs("ids"), longs("labels"))
            names, q_ids, q_labels = longs("q_queries"), longs("q_ids"), longs("q_labels")
            q = np.frombuffer(r["q_vectors"], r["q_kind"]).reshape(len(names), dims).astype(np.float64)
            low, high = longs("q_low").reshape(len(names), -1), longs("q_high").reshape(len(names), -1)
            for a in range(0, len(names), SLICE):
                part = slice(a, a + SLICE)
                got = tree.search(q[part], q_labels[part], q_ids[part], low[part], high[part], k, same)
                if len(got):
                    out.append(pa.table({
                        "_row": names[part][got[:, 0].astype(int)], "window": pa.array(got[:, 1].astype(np.int32)),
                        "score": got[:, 2].astype(np.int64), "id": got[:, 3].astype(np.int64)}))
        empty = pa.table({"_row": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        return pa.concat_tables(out) if out else empty

    return search


def plant(rows: DataFrame) -> Forest:
    """Forest over ``_row, _id, label, v`` (see ``whole_rows``)."""
    rows = cut(rows, "vectors")
    count, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(1, dims)
    size = min(MOST_TREE, max(LEAST_TREE, -(-count // TREES)))
    tiled, total = _tiled(rows, count, size)
    trees = cut(tiled.groupBy("tree").applyInArrow(_tree_maker(dims), _TREE), "trees")
    return Forest(rows, trees, total, dims)


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``; ``anchor`` is a condition over ``_id`` (null
    identifiers as the largest long, which come last and are returned as null), ``label``
    an expression that replaces the label. A vector shorter than others is filled up with
    zeros. An anchor's positives are its best rows of the same label and another
    identifier; repeated rows count each, also as anchors. A positive with a negative score
    has an empty window, one of zero the window zero. Partners whose score is beyond a long
    are left out. Pairs without negatives have no rows; other columns are not read.
    """
    rows = whole_rows(vectors)
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    forest = plant(rows)
    anchors = forest.rows.where(anchor & (F.col("_id") != LAST_ID))
    every = F.array(F.struct(F.lit(-_LONG).alias("low"), F.lit(_LONG).alias("high")))
    near = cut(forest.best(anchors.withColumn("windows", every), positives, True), "positives")
    # ceil(score * 50 / 100) and floor(score * 95 / 100) in whole numbers, without a product that could pass a long
    hundreds, rest = F.expr("score div 100"), F.expr("score % 100")
    low = hundreds * FROM_SHARE + F.ceil(rest * FROM_SHARE / F.lit(100)).cast("long")
    high = hundreds * UPTO_SHARE + F.floor(rest * UPTO_SHARE / F.lit(100)).cast("long")
    listed = near.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("_w"))
    asked = anchors.join(listed, "_row").withColumn("windows", F.transform("_w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high")))).drop("_w")
    found = forest.best(asked, negatives, False).select("_row", (F.col("window") + 1).alias("_place"), F.col("rank").alias("_rank"), F.col("score").alias("negative_score"), F.col("id").alias("_neg"))
    pairs = near.select("_row", F.col("rank").alias("_place"), F.col("id").alias("_pos"), F.col("score").alias("positive_score"))
    names = anchors.select("_row", F.col("_id").alias("anchor_id"))
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return found.join(pairs, ["_row", "_place"]).join(names, "_row").select(
        "anchor_id", real("_pos").alias("positive_id"), F.col("_rank").cast("int").alias("rank"), real("_neg").alias("negative_id"), "positive_score", "negative_score")
