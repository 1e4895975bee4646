"""The monthly run: tables by month, rebuilt whole, plus its counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.functions.accounts import LINKED
from tallyweave.operators.reconcile import match_invoices


def write_month(df: DataFrame, path: str, months: list[str] | None = None) -> None:
    """Replace the months present in ``df``; running it twice changes nothing.

    ``months`` names the months that are rebuilt: one of them without rows is cleared.
    Readers may meet a half-replaced table; ``publish`` swaps whole versions.
    """
    if months is not None:
        spark = df.sparkSession
        held = {r.month for r in df.where(F.col("month").isin(list(months))).select("month").distinct().collect()}
        conf = spark._jsc.hadoopConfiguration()
        for month in set(months) - held:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={month}")
            folder.getFileSystem(conf).delete(folder, True)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_month(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if month is None else df.where(F.col("month") == month)


def save_month_table(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Catalog table ``name`` at ``path``, a folder for each ``month``, in ``buckets`` of ``key`` sorted by it.

    Tables with one key and number of buckets join on the key without a shuffle. The rows of
    a bucket of a month are dealt to one task, so it is one file however many tasks write:
    choose ``buckets`` so that it fits a task in the fullest month. Rows of one key stay
    together, so the key must be (nearly) unique, as the identifiers of entries and
    transactions are.
    """
    bucket = F.pmod(F.hash(key), F.lit(buckets))  # as Spark's writer numbers them
    (
        df.repartition("month", bucket).write.mode("overwrite").partitionBy("month").bucketBy(buckets, key).sortBy(key)
        .option("path", path).saveAsTable(name)
    )
    return df.sparkSession.table(name)


def in_months(facts: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of a table written by month whose ``month`` is in ``months``.

    ``months`` may come from any filter on a calendar of periods: Spark hands its result to
    the scan (dynamic partition pruning), which opens the folders of those months only.
    """
    return facts.join(months.select("month"), "month", "left_semi")


def rows_of_month(child: DataFrame, parent: DataFrame, key: str, month: str) -> DataFrame:
    """Child rows whose parent lies in the month: what a rebuild replaces."""
    return child.join(parent.where(F.col("month") == month).select(key), key, "left_semi")


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``key NOT IN (SELECT right_key ...)`` with SQL null rules, as a hash or merge join.

    Any null on the right leaves no rows; a null on the left is dropped unless
    the right side is empty. The right side is never broadcast whole.
    """
    facts = right.agg(F.count_if(F.col(right_key).isNull()).alias("_nulls"), F.count("*").alias("_n"))
    kept = left.join(right.select(F.col(right_key).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")
    return kept.crossJoin(F.broadcast(facts)).where(  # one row
        (F.col("_nulls") == 0) & (F.col(key).isNotNull() | (F.col("_n") == 0))
    ).select(*left.columns)


def month_stats(
    ledger: DataFrame, attachments: DataFrame, fiscal: DataFrame, recon: DataFrame, fuel_records: DataFrame | None = None,
) -> DataFrame:
    """Imported, pending, attachments, invoices, reconciliations per month of the ledger.

    With ``fuel_records(month, status)`` also fuel receipts and those linked; months that
    only they have are added.
    """
    base = ledger.groupBy("month").agg(
        F.count("*").alias("imported"), F.count_if(F.col("status") == "manual_review").alias("pending"))
    att = attachments.groupBy("entry_id").agg(F.count("*").alias("n")).join(ledger.select("entry_id", "month"), "entry_id")
    att = att.groupBy("month").agg(F.sum("n").alias("attachments"))
    fis = fiscal.groupBy(F.date_format("issue_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("fiscal"))
    rec = recon.join(ledger.select("tx_id", "month"), "tx_id").groupBy("month").agg(F.count("*").alias("reconciliations"))
    out = base
    for side in (att, fis, rec):
        out = out.join(side, "month", "left")
    if fuel_records is None:
        return out.na.fill(0, ["attachments", "fiscal", "reconciliations"])
    return out.join(fuel_counters(fuel_records), "month", "full_outer").na.fill(0)


def fuel_counters(fuel_records: DataFrame) -> DataFrame:
    """Receipts of each ``month`` and those with an entry."""
    return fuel_records.groupBy("month").agg(F.count("*").alias("fuel_documents"), F.count_if(F.col("status") == LINKED).alias("fuel_linked"))


def reconcile_month(tx: DataFrame, fiscal: DataFrame, month: str, recon: DataFrame | None = None, **kwargs) -> DataFrame:
    """Match one month's transactions that are not reconciled yet with the month's invoices."""
    t = tx.where(F.date_format("tx_date", "yyyy-MM") == month)
    f = fiscal.where(F.date_format("issue_date", "yyyy-MM") == month)
    if recon is not None:
        t = t.join(recon.select("tx_id"), "tx_id", "left_anti")
    return match_invoices(t, f, **kwargs)
