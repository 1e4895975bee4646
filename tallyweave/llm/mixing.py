"""Mixing sources to target weights by Pareto order sampling.

The targets of the sources, and the expected copies of the documents inside a
source, are both a share-out by weight below a cap. Whole copies are certain. The
fractional rest is a document's inclusion probability: documents are ranked by
random odds over inclusion odds, and the lowest ranks are taken until the source
has its words. What decides about a document is one place on that ranking, so a
mix is stored as one row for each source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import WORD, id_order, packed, running, unpacked
from tallyweave.session import cut

#: Sources' weights by code point order of their names, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2


def n_words(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def digits(size: Column) -> Column:
    """Importance of a document: the number of digits of its size. Long documents count somewhat more."""
    return F.length(size.cast("string")).cast("long")


def odds(size: Column, level: Column, doc_id: Column, seed: str) -> tuple[Column, Column]:
    """Certain copies of a document, and its rank: random odds over inclusion odds (null: nothing left to chance).

    The random number is a hash of seed and identifier, so that a repeated task or
    run draws the same.
    """
    expected = F.least(F.lit(float(MAX_COPIES)), level * digits(size).cast("double"))
    whole = F.floor(expected + F.lit(1e-9))
    part = expected - whole
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    drawn = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    rank = F.when(part > 1e-9, (drawn / (1 - drawn)) / (part / (1 - part)))
    return whole.cast("long"), rank


def beside(docs: DataFrame, sources: DataFrame, how: str = "inner", salts: int = 8) -> DataFrame:
    """``docs`` (``_src, _id, size`` and more) with their source's row (``_name`` and more). A source's documents are dealt over ``salts`` places."""
    s = sources.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    d = docs.withColumn("_d", F.pmod(F.xxhash64("_id", "size"), F.lit(salts)).cast("int"))
    return d.join(s, F.col("_src").eqNullSafe(F.col("_name")) & (F.col("_s") == F.col("_d")), how).drop("_s", "_d")


@dataclass(frozen=True)
class Mix:
    """``sizes``: the documents without their texts. ``sources``: per source its target and where its ranking is cut."""

    sizes: DataFrame
    sources: DataFrame
    seed: str

    def decide(self, docs: DataFrame) -> DataFrame:
        """``docs`` (``_id, _src, size`` and any more) with ``source_size, target, copies, taken``."""
        j = beside(docs, self.sources, "left")
        whole, rank = odds(F.col("size"), F.col("_level"), F.col("_raw"), self.seed)
        place = F.struct(rank.alias("rank"), F.col("_id"), F.col("size"))
        chosen = F.coalesce((rank.isNotNull() & (place <= F.col("_last"))).cast("long"), F.lit(0))
        copies = F.when(F.col("size") > 0, whole + chosen).otherwise(F.lit(0)).cast("long")
        out = j.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
        return out.drop("_name", "_level", "_last")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: str = "mix") -> Mix:
    """Lay out a mix of ``docs``.

    A source's target is its weight's share of ``share`` times all words, at most
    twice its own words; what is above is shared again by weight. A document's
    expected copies follow its importance, at most two. Null sources are one source,
    after all others; null or empty texts and texts of white space have size 0 and
    are never taken; a null identifier has a draw of its own. Rows with equal
    identifiers have equal draws, and equal rows are taken together or not at all. An
    empty table gives no rows. A source's words differ from its target by at most
    half of the document at the cut (or group of equal rows there).
    """
    sizes = cut(docs.select(
        F.col(id_col).cast("long").alias("_raw"), id_order(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("_src"), n_words(text_col).alias("size")), "sizes")
    per_level = sizes.withColumn("_v", digits(F.col("size"))).groupBy("_src", "_v").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    named = cut(
        per_level.groupBy("_src").agg(F.sum("words").alias("source_size"))
        .withColumn("_null", F.col("_src").isNull()).withColumn("one", F.lit(1).cast("long")), "sources")
    placed = running(named, [], ["_null", "_src"], ["one"], label="names")
    k = F.col("before_one") % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(k == i, w).otherwise(weight)
    capped = placed.select("_src", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * MAX_COPIES).alias("cap"))
    capped = capped.withColumn("full_at", F.col("cap") / F.col("weight").cast("double"))
    # The level is the largest that any split into full and open sources gives: a minimum of lines, turned round.
    order = running(cut(capped, "caps"), [], ["full_at"], ["cap", "weight"], label="caps")
    total = capped.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    top = order.agg(F.max(
        (F.lit(float(total["words"] * share)) - F.col("before_cap")) / (F.lit(total["weight"]) - F.col("before_weight")))).first()[0]
    targets = cut(capped.select(
        "_src", "source_size", F.least(F.col("cap").cast("double"), F.lit(float(top or 0.0)) * F.col("weight")).alias("target")), "targets")

    # Inside a source the same share-out, over the sizes at each importance.
    steps = per_level.where("words > 0").select("_src", "_v", (-F.col("_v")).alias("_fall"), "words", (F.col("words") * F.col("_v")).alias("pull"))
    steps = running(cut(steps, "steps"), ["_src"], ["_fall"], ["words", "pull"], label="steps")
    pulls = steps.groupBy("_src").agg(F.sum("pull").alias("all_pull"))
    same = lambda a, b: a["_src"].eqNullSafe(b["_src"])
    level = (F.col("target") - F.lit(float(MAX_COPIES)) * F.col("before_words")) / (F.col("all_pull") - F.col("before_pull"))
    levels = (
        steps.join(pulls, same(steps, pulls)).drop(pulls["_src"]).join(targets.select(F.col("_src").alias("_t"), "target"), F.col("_src").eqNullSafe(F.col("_t")))
        .groupBy("_src").agg(F.max(level).alias("_level")))
    ready = targets.join(levels.withColumnRenamed("_src", "_l"), F.col("_src").eqNullSafe(F.col("_l")), "left").select(
        F.col("_src").alias("_name"), "source_size", "target", F.coalesce("_level", F.lit(0.0)).alias("_level"))
    ready = cut(ready, "levels")

    # Whole copies first; the ranking of the rest is summed up to the words still open.
    open_mix = Mix(sizes, ready.withColumn("_last", F.lit(None).cast("struct<rank:double,_id:bigint,size:bigint>")), seed)
    certain = open_mix.decide(sizes.where("size > 0"))
    whole, rank = odds(F.col("size"), F.col("_level"), F.col("_raw"), seed)
    graded = beside(sizes.where("size > 0"), ready).select("_src", "_id", "size", rank.alias("rank"))
    ranked = running(cut(graded.where(F.col("rank").isNotNull()), "ranks"), ["_src"], ["rank", "_id", "size"], ["size"], label="ranks")
    rest = certain.groupBy("_src").agg(F.sum("taken").alias("sure"))
    rest = ready.join(rest, F.col("_name").eqNullSafe(F.col("_src")), "left").select("_name", (F.col("target") - F.coalesce("sure", F.lit(0))).alias("rest"))
    cuts = (
        beside(ranked, rest)
        .where(F.col("before_size") + F.col("same_size") / 2 <= F.col("rest"))
        .groupBy("_name").agg(F.max(F.struct("rank", "_id", "size")).alias("_last")))
    cuts = cuts.select(F.col("_name").alias("_c"), "_last")
    sources = ready.join(cuts, F.col("_name").eqNullSafe(F.col("_c")), "left").drop("_c")
    return Mix(sizes, cut(sources, "mix"), seed)


def mixed(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, those taken twice twice, with the columns of ``docs``.

    The decision is made row by row against the table of sources: no text moves while
    that table is small enough for Spark to broadcast it.
    """
    rows = packed(
        docs, F.col(id_col).cast("long").alias("_raw"), id_order(id_col).alias("_id"), F.col(source_col).cast("string").alias("_src"),
        n_words(text_col).alias("size"))
    taken = mix.decide(rows).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unpacked(taken, docs)
