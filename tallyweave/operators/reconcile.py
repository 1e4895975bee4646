"""Bank transactions against invoices: value and date window, tax id, exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.dates import day_number
from tallyweave.functions.money import RECONCILE_CENTS, cents, tax_id
from tallyweave.operators.matching import greedy_assign
from tallyweave.session import many

WINDOW_DAYS = 3  # fixed value
SCORE = {0: 1.0, 1: 0.7}  # fixed values: with equal tax ids, without


def blocks(value: Column, reach: int) -> Column:
    """Blocks of ``2*reach+1`` whole numbers (cents, days) that the window around ``value`` touches: at most two."""
    width = 2 * reach + 1
    lo, hi = F.floor((value - reach) / width), F.floor((value + reach) / width)
    return F.explode(F.array_distinct(F.array(lo, hi)))


def block(column: str, reach: int) -> Column:
    """The block in which a value of ``column`` lies."""
    return F.floor(F.col(column) / (2 * reach + 1))


def within(column: str, other: str, reach: int) -> Column:
    return F.abs(F.col(column) - F.col(other)) <= reach


def near_copies(right: DataFrame, tol: int, reach: int) -> DataFrame:
    """``right(cents, day)`` copied to the blocks of cents ``_c`` and of days ``_b`` that it can reach: four at most."""
    near = right.withColumnRenamed("cents", "r_cents").withColumnRenamed("day", "r_day")
    return near.withColumn("_c", blocks(F.col("r_cents"), tol)).withColumn("_b", blocks(F.col("r_day"), reach))


def cell_lists(cells: DataFrame, right: DataFrame, tol: int, reach: int) -> DataFrame:
    """Right rows within tolerance of each cell ``(cents, day)``.

    Each right row is copied to the blocks of cents and days it can reach, at most four
    copies, and meets distinct cells only; a cell meets the rows of its own block of either.
    """
    keyed = cells.withColumn("_c", block("cents", tol)).withColumn("_b", block("day", reach))
    met = keyed.join(many(near_copies(right, tol, reach)), ["_c", "_b"])
    return met.where(within("cents", "r_cents", tol) & within("day", "r_day", reach)).drop("_c", "_b")


def _sides(tx: DataFrame, fiscal: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = tx.select(
        F.col("tx_id").alias("left_id"), cents("amount").alias("cents"), day_number("tx_date").alias("day"),
        tax_id("counterparty_doc").alias("doc"),
    ).where("cents IS NOT NULL AND day IS NOT NULL")
    right = fiscal.select(
        F.col("fiscal_id").alias("right_id"), cents("total_value").alias("cents"), day_number("issue_date").alias("day"),
        tax_id("counterparty_doc").alias("doc"),
    ).where("cents IS NOT NULL AND day IS NOT NULL")
    return left, right


def near_value(column: str) -> Column:
    """Rows that may compete: equal amounts, and by their order those next to each other."""
    return F.col(column).cast("string")


def _general(cents_: str = "cents", day: str = "day") -> Column:
    return F.concat_ws("|", F.lit("g"), F.col(cents_), F.col(day))


def _by_doc(cents_: str = "cents", day: str = "day", doc: str = "doc") -> Column:
    return F.concat_ws("|", F.lit("d"), F.col(cents_), F.col(day), F.col(doc))


def preference_lists(
    tx: DataFrame, fiscal: DataFrame, tol: int = RECONCILE_CENTS, reach: int = WINDOW_DAYS
) -> tuple[DataFrame, DataFrame]:
    """``left_lists`` and ``lists`` for the matcher: equal tax ids first, then any."""
    left, right = _sides(tx, fiscal)
    near = cell_lists(left.select("cents", "day").distinct(), right, tol, reach)
    general = near.select(_general().alias("list_id"), "right_id")
    classes = left.where("doc IS NOT NULL").select("cents", "day", "doc").distinct()
    same_doc = cell_lists_by_doc(classes, right, tol, reach).select(_by_doc().alias("list_id"), "right_id")
    named = F.array(
        F.struct(F.lit(0).alias("tier"), F.when(F.col("doc").isNotNull(), _by_doc()).alias("list_id")),
        F.struct(F.lit(1).alias("tier"), _general().alias("list_id")),
    )
    left_lists = left.select("left_id", near_value("cents").alias("place"), F.inline(named)).where("list_id IS NOT NULL")
    return left_lists, general.unionByName(same_doc)


def cell_lists_by_doc(classes: DataFrame, right: DataFrame, tol: int, reach: int) -> DataFrame:
    """As ``cell_lists`` where the tax id must agree too; the id is part of the join key."""
    near = near_copies(right.where("doc IS NOT NULL").select("right_id", "doc", "cents", "day"), tol, reach)
    keyed = classes.withColumn("_c", block("cents", tol)).withColumn("_b", block("day", reach))
    met = keyed.join(many(near), ["doc", "_c", "_b"])
    return met.where(within("cents", "r_cents", tol) & within("day", "r_day", reach)).drop("_c", "_b")


def candidate_summary(
    tx: DataFrame, fiscal: DataFrame, tol: int = RECONCILE_CENTS, reach: int = WINDOW_DAYS
) -> DataFrame:
    """Per transaction: how many invoices are in reach, how many share its tax id, and the first of each.

    Computed per list, so transactions that share value, date and tax id are counted once.
    """
    left_lists, lists = preference_lists(tx, fiscal, tol, reach)
    sums = lists.groupBy("list_id").agg(F.count("*").alias("n"), F.min("right_id").alias("first"))
    hit = left_lists.join(sums, "list_id")
    same = F.col("tier") == 0
    return hit.groupBy(F.col("left_id").alias("tx_id")).agg(
        F.max(F.when(~same, F.col("n"))).alias("candidates"),
        F.coalesce(F.max(F.when(same, F.col("n"))), F.lit(0)).alias("same_tax_id"),
        F.max(F.when(~same, F.col("first"))).alias("first_candidate"),
        F.max(F.when(same, F.col("first"))).alias("first_same_tax_id"),
    )


def match_invoices(
    tx: DataFrame, fiscal: DataFrame, direction: str = "all", confirmed: bool = True,
    tol: int = RECONCILE_CENTS, reach: int = WINDOW_DAYS,
) -> DataFrame:
    """Exclusive matches in transaction order. ``direction='out'`` takes outgoing payments only."""
    if direction == "out":
        tx = tx.where("amount < 0")
    matches = greedy_assign(*preference_lists(tx, fiscal, tol, reach))
    exact = F.col("tier") == 0
    return matches.select(
        F.col("left_id").alias("tx_id"),
        F.col("right_id").alias("fiscal_id"),
        F.when(exact, "exact").otherwise("fuzzy").alias("match_type"),
        F.when(exact, F.lit(SCORE[0])).otherwise(F.lit(SCORE[1])).alias("match_score"),
        F.lit(confirmed).alias("confirmed"),
    )


def unreconciled(tx: DataFrame, reconciliations: DataFrame) -> DataFrame:
    return tx.join(reconciliations.select("tx_id"), "tx_id", "left_anti")


def match_counts(tx: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """Matched and unmatched transactions: one row."""
    flagged = tx.select("tx_id").join(reconciliations.select("tx_id", F.lit(1).alias("_m")), "tx_id", "left")
    return flagged.agg(F.count("_m").alias("matched"), F.count_if(F.col("_m").isNull()).alias("unmatched_bank"))


def card_settlements(tx: DataFrame, expected: DataFrame, tol: int = RECONCILE_CENTS) -> DataFrame:
    """Bank rows on dates with expected card sales: signed difference and status.

    ``expected`` has one row per date, so the join never multiplies rows.
    """
    diff = F.col("amount") - F.col("expected_sales")
    return tx.join(expected, "tx_date").select(
        "tx_id", "tx_date", F.col("amount").alias("bank_amount"), "expected_sales",
        F.round(diff, 2).alias("diff"),
        F.when(F.abs(diff) * 100 <= tol, "ok").otherwise("diverge ⚠️").alias("status"),
    )
