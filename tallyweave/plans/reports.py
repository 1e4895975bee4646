"""Ledger views, filters, totals and coverage. Dimensions are joined without hints:
Spark broadcasts them only below its own size threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions import accounts as acc
from tallyweave.functions.text import accounts_search_key, all_tokens


def sum_if(cond: Column, value: str = "amount") -> Column:
    return F.sum(F.when(cond, F.col(value)).otherwise(F.lit(0)))


def with_account_names(ledger: DataFrame, chart: DataFrame) -> DataFrame:
    """Debit and credit account names; unknown codes keep their rows."""
    debit = chart.select(F.col("code").alias("debit_account"), F.col("name").alias("debit_name"))
    credit = chart.select(F.col("code").alias("credit_account"), F.col("name").alias("credit_name"))
    return ledger.join(debit, "debit_account", "left").join(credit, "credit_account", "left")


def enrich(ledger: DataFrame, tx: DataFrame, chart: DataFrame) -> DataFrame:
    """Ledger lines with their transaction's columns and both account names."""
    extra = [c for c in tx.columns if c not in ledger.columns]
    return with_account_names(ledger.join(tx.select("tx_id", *extra), "tx_id"), chart)


def filter_ledger(
    ledger: DataFrame, month: str | None = None, status: str | None = None, account: str | None = None
) -> DataFrame:
    """Every given condition must hold; an absent one holds always."""
    for column, value in (("month", month), ("status", status), ("bank_account_id", account)):
        if value:
            ledger = ledger.where(F.col(column) == value)
    return ledger


def search_text(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows whose joined columns hold the text, ignoring case."""
    hay = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return df.where(F.lower(hay).contains(query.lower()))


LEDGER_SEARCH = ["description", "counterparty", "category", "debit_account", "credit_account"]
RECEIPT_SEARCH = ["file_name", "station", "doc_date"]


def search_accounts(chart: DataFrame, query: str, limit: int = 80) -> DataFrame:
    """First accounts in code order that hold every token of the query."""
    hits = chart if not query else chart.where(all_tokens(accounts_search_key("code", "name"), query))
    return hits.orderBy("code").limit(limit)


def bank_summary(ledger: DataFrame, bank_accounts: DataFrame, month: str | None = None) -> DataFrame:
    """Per registered bank account: inflow, outflow, count, pending."""
    banks = bank_accounts.select("bank_account_id", "coa_code")
    return (
        filter_ledger(ledger, month).join(banks, "bank_account_id").groupBy("bank_account_id").agg(
            sum_if(F.col("debit_account") == F.col("coa_code")).alias("inflow"),
            sum_if(F.col("credit_account") == F.col("coa_code")).alias("outflow"),
            F.count("*").alias("n"),
            F.count_if(F.col("status") == "manual_review").alias("pending"),
        )
    )


def t_account(ledger: DataFrame) -> DataFrame:
    """Debit and credit totals per account. Both sides come from one scan and one shuffle."""
    zero = F.lit(0).cast("decimal(18,2)")
    sides = F.array(
        F.struct(F.col("debit_account").alias("account"), F.col("amount").alias("debit"), zero.alias("credit")),
        F.struct(F.col("credit_account").alias("account"), zero.alias("debit"), F.col("amount").alias("credit")),
    )
    return ledger.select(F.inline(sides)).groupBy("account").agg(
        F.sum("debit").alias("debit"), F.sum("credit").alias("credit")
    )


def category_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("category", "status").agg(F.count("*").alias("n"))


def fuel_by_bank(ledger: DataFrame) -> DataFrame:
    return ledger.where(acc.fuel_entry()).groupBy(F.coalesce("bank_account_id", F.lit("—")).alias("bank")).agg(
        F.sum("amount").alias("total"), F.count("*").alias("n")
    )


def dashboard(ledger: DataFrame, attachments: DataFrame) -> DataFrame:
    """Entries, pending, entries with attachments, bank accounts: one row."""
    linked = attachments.select("entry_id").distinct().withColumn("_has", F.lit(1))
    return ledger.join(linked, "entry_id", "left").agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("status") == "manual_review").alias("pending"),
        F.count("_has").alias("with_attachments"),
        F.countDistinct("bank_account_id").alias("banks"),
    )


def receipt_counts(fuel_records: DataFrame) -> DataFrame:
    linked = F.col("status") == acc.LINKED
    return fuel_records.agg(
        F.count("*").alias("documents"),
        F.count_if(linked).alias("linked"),
        F.count_if(~linked).alias("document_only"),
        F.sum("amount").alias("total"),
    )


def client_entries(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("category").ilike("%cliente%"))


def invoice_coverage(ledger: DataFrame, attachments: DataFrame) -> DataFrame:
    """Client entries with and without an invoice attached."""
    with_invoice = attachments.where(F.col("file_name").ilike("%DANFE%")).select("entry_id").distinct()
    flagged = client_entries(ledger).join(with_invoice.withColumn("_has", F.lit(1)), "entry_id", "left")
    return flagged.agg(
        F.count("*").alias("clients"), F.count("_has").alias("with_invoice"),
        F.count_if(F.col("_has").isNull()).alias("without_invoice"),
    )


def missing_invoice(ledger: DataFrame, attachments: DataFrame) -> DataFrame:
    """Client entries no invoice is attached to."""
    has = attachments.where(F.col("file_name").ilike("%DANFE%")).select("entry_id")
    return client_entries(ledger).join(has, "entry_id", "left_anti")


# Labels shown for a status.
STATUS_LABELS = {"matched": "Conciliado", "manual_review": "Revisar", "pending": "Pendente"}


def status_label(status: str = "status") -> Column:
    out = F.col(status)
    for value, label in STATUS_LABELS.items():
        out = F.when(F.col(status) == value, label).otherwise(out)
    return out


def top_receipts(ledger: DataFrame, k: int = 15) -> DataFrame:
    """The k largest client entries; ties by id."""
    return client_entries(ledger).orderBy(F.desc("amount"), "entry_id").limit(k)


def sorted_chart(chart: DataFrame) -> DataFrame:
    """Accounts in numeric-aware code order."""
    return chart.orderBy(acc.code_sort_key("code"), "code")


def account_counts(chart: DataFrame, supplier_prefix: str = "2.01.01.01.01.") -> DataFrame:
    return chart.groupBy("type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("code").startswith(supplier_prefix)).alias("suppliers"),
        F.count_if(F.col("name") == F.col("code")).alias("unnamed"),
    )


def attachment_list(ledger: DataFrame, attachments: DataFrame, month: str | None = None, entry_id: int | None = None) -> DataFrame:
    """Attachments with their entry's date, for one month or one entry."""
    entries = filter_ledger(ledger, month).select("entry_id", "entry_date")
    if entry_id is not None:
        entries = entries.where(F.col("entry_id") == entry_id)
    return attachments.join(entries, "entry_id")


def ledger_with_attachments(ledger: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row per entry and attachment; entries without one are kept."""
    return ledger.join(attachments.select("entry_id", "file_name"), "entry_id", "left")


def value_lookup(fiscal: DataFrame, value: float, tolerance: float = 0.05) -> DataFrame:
    """Invoices whose total lies strictly within the tolerance of a value."""
    v = F.lit(str(value)).cast("decimal(18,2)")
    t = F.lit(str(tolerance)).cast("decimal(18,2)")
    return fiscal.where((F.col("total_value") > v - t) & (F.col("total_value") < v + t))
