"""File inventory, fuel receipts and tax-guide text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions import filenames as fn
from tallyweave.functions.dates import parse_br_date
from tallyweave.functions.money import parse_money
from tallyweave.functions.text import _c


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files as rows. The content column is not selected, so no file is opened."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )


def inventory(files: DataFrame, bank_rules: list[tuple[str, str, str]]) -> DataFrame:
    """Indexable files with name, extension, kind, bank account and the meaning of slip names."""
    kept = files.where(fn.indexable("path")).select(
        "*",
        fn.base_name("path").alias("name"),
        fn.extension("path").alias("ext"),
        fn.file_kind("path").alias("kind"),
        fn.path_id("path", "modified").alias("hash"),
    )
    slip, transfer = fn.slip_meta("name"), fn.transfer_meta("name")
    is_slip = F.col("kind") == "comprovante"
    return fn.with_bank_by_path(kept, bank_rules).select(
        "*",
        F.when(is_slip, F.coalesce(slip["date"], transfer["date"])).alias("meta_date"),
        F.when(is_slip, slip["type"]).alias("meta_type"),
        F.when(is_slip, slip["amount"]).alias("meta_amount"),
        F.when(is_slip & slip.isNull(), transfer["counterparty"]).alias("meta_counterparty"),
    )


def files_by_kind(files: DataFrame) -> DataFrame:
    """Count per kind and, with a null kind, the total."""
    return files.rollup("kind").agg(F.count("*").alias("n"))


def fuel_receipts(files: DataFrame, name: str = "file_name", modified: str = "modified") -> DataFrame:
    """Receipts with the date and time their names carry."""
    kept = files.where(~F.col(name).rlike(fn.SKIPPED_FILES) & fn.extension(name).isin(*fn.FUEL_EXTENSIONS))
    meta = fn.fuel_meta(name, modified)
    return kept.select("*", fn.extension(name).alias("ext"), meta["doc_date"].alias("doc_date"), meta["doc_time"].alias("doc_time"))


def tax_guide(text) -> Column:
    """Amount after one of three labels, due date, and the first 500 characters."""
    t = F.coalesce(_c(text), F.lit(""))
    label = r"(?is)Valor (?:a recolher|Total a Recolher|Total do Documento).{0,30}?([\d.,]+)"
    amount = F.regexp_extract(t, label, 1)
    due = F.regexp_extract(t, r"(?i)Vencimento[:\s]*?(\d{2}/\d{2}/\d{4})", 1)
    return F.struct(
        F.when(amount != "", parse_money(amount)).alias("amount"),
        parse_br_date(due).alias("due_date"),
        F.left(t, F.lit(500)).alias("excerpt"),
    )
