"""Manual corrections laid over the ledger, and account upserts.

Corrections are rows ``(entry_id, seq, fields...)``; a null or empty field
leaves the ledger's value, a later row wins per field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.plans.reports import with_account_names

FIELDS = ("debit_account", "credit_account", "category", "status")


def latest_fields(changes: DataFrame, order: str = "seq") -> DataFrame:
    """One row per entry: per field the latest non-empty value."""

    def latest(f: str):
        given = F.when(F.col(f) != "", F.col(f))
        return F.max_by(given, F.when(given.isNotNull(), F.col(order))).alias(f"new_{f}")

    return changes.groupBy("entry_id").agg(*[latest(f) for f in FIELDS])


def apply_changes(ledger: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    patched = ledger.join(latest_fields(changes, order), "entry_id", "left")
    for f in FIELDS:
        patched = patched.withColumn(f, F.coalesce(f"new_{f}", f))
    return patched.drop(*[f"new_{f}" for f in FIELDS])


def overlay(ledger: DataFrame, changes: DataFrame, chart: DataFrame, order: str = "seq") -> DataFrame:
    """Patched ledger with account names looked up again."""
    return with_account_names(apply_changes(ledger, changes, order), chart)


def pending_by_bank(ledger: DataFrame, bank_accounts: DataFrame) -> DataFrame:
    """Pending entries per registered account (0 where none) and, with a null account, overall."""
    per_bank = ledger.where("bank_account_id IS NOT NULL").groupBy("bank_account_id").agg(
        F.count_if(F.col("status") == "manual_review").alias("pending")
    )
    listed = bank_accounts.select("bank_account_id").join(per_bank, "bank_account_id", "left").select(
        "bank_account_id", F.coalesce("pending", F.lit(0)).alias("pending")
    )
    total = ledger.agg(F.count_if(F.col("status") == "manual_review").alias("pending")).select(
        F.lit(None).cast("string").alias("bank_account_id"), "pending"
    )
    return listed.unionByName(total)


def upsert_accounts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new codes, replace name and type of known ones."""
    c, n = current.alias("c"), incoming.alias("n")
    return c.join(n, F.col("c.code") == F.col("n.code"), "full_outer").select(
        F.coalesce("n.code", "c.code").alias("code"),
        F.coalesce("n.name", "c.name").alias("name"),
        F.coalesce("n.type", "c.type").alias("type"),
    )


def upsert_bank_codes(banks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new accounts; a known account only takes the new posting code."""
    n = incoming.select(*[F.col(c).alias(f"n_{c}") for c in incoming.columns])
    joined = banks.join(n, F.col("bank_account_id") == F.col("n_bank_account_id"), "full_outer")
    out = [
        F.coalesce("n_coa_code", "coa_code").alias("coa_code") if c == "coa_code" else F.coalesce(c, f"n_{c}").alias(c)
        for c in banks.columns
    ]
    return joined.select(*out)
