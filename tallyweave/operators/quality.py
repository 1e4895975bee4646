"""Checks for what table constraints would enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.schemas import ACCOUNT_TYPES, LEDGER_STATUS


def orphan_accounts(ledger: DataFrame, chart: DataFrame) -> DataFrame:
    """Account codes used by the ledger and absent from the chart, with their uses.

    Codes are counted first, so the anti join sees one row per code.
    """
    sides = F.array(
        F.struct(F.lit("debit").alias("side"), F.col("debit_account").alias("account")),
        F.struct(F.lit("credit").alias("side"), F.col("credit_account").alias("account")),
    )
    used = ledger.select(F.inline(sides)).groupBy("side", "account").agg(F.count("*").alias("n"))
    return used.join(chart.select(F.col("code").alias("account")), "account", "left_anti")


def enum_violations(ledger: DataFrame, chart: DataFrame) -> DataFrame:
    """Values outside their domain, per table and column."""
    status = ledger.where(~F.coalesce(F.col("status").isin(*LEDGER_STATUS), F.lit(False))).groupBy(
        F.col("status").alias("value")).agg(F.count("*").alias("n")).select(F.lit("ledger.status").alias("field"), "value", "n")
    kinds = chart.where(~F.coalesce(F.col("type").isin(*ACCOUNT_TYPES), F.lit(False))).groupBy(
        F.col("type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("chart.type").alias("field"), "value", "n")
    return status.unionByName(kinds)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per required column: one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def balance(ledger: DataFrame) -> DataFrame:
    """Debit and credit sums per month; they must agree."""
    return ledger.groupBy("month").agg(
        F.sum(F.when(F.col("debit_account").isNotNull(), F.col("amount"))).alias("debits"),
        F.sum(F.when(F.col("credit_account").isNotNull(), F.col("amount"))).alias("credits"),
    ).withColumn("balanced", F.coalesce(F.col("debits") == F.col("credits"), F.lit(False)))
