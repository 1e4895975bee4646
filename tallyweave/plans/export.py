"""Export shapes: nested month documents, delimited rows, text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions.dates import format_br_date
from tallyweave.plans.reports import with_account_names

# Titles of the delimited export.
EXPORT_TITLES = (
    "Data", "Histórico", "Conta Débito", "Nome Débito", "Conta Crédito", "Nome Crédito",
    "Valor", "Categoria", "Status", "Banco", "Anexos",
)
BOM = "﻿"


def nest_attachments(ledger: DataFrame, attachments: DataFrame) -> DataFrame:
    """Entries with an array of their attachments, ordered by name; empty where none.

    The attachment side is grouped before the join, so the ledger is not multiplied.
    """
    item = F.struct("file_name", "file_type", "match_type", "match_score")
    nested = attachments.groupBy("entry_id").agg(F.sort_array(F.collect_list(item)).alias("attachments"))
    out = ledger.join(nested, "entry_id", "left")
    empty = F.array().cast(nested.schema["attachments"].dataType)
    return out.withColumn("attachments", F.coalesce("attachments", empty))


def write_month_documents(nested: DataFrame, path: str) -> None:
    """One JSON line per entry, one folder per month; only months present are replaced."""
    nested.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").json(path)


def read_month_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_rows(ledger: DataFrame, chart: DataFrame, nested: DataFrame) -> DataFrame:
    """The eleven export columns as text."""
    names = F.array_join(F.transform("attachments", lambda a: a["file_name"]), "; ")
    e = with_account_names(nested, chart)

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return e.select(
        F.col("entry_id"),
        format_br_date("entry_date").alias("date"),
        text("description").alias("description"),
        text("debit_account").alias("debit_account"),
        text("debit_name").alias("debit_name"),
        text("credit_account").alias("credit_account"),
        text("credit_name").alias("credit_name"),
        text("amount").alias("amount"),
        text("category").alias("category"),
        text("status").alias("status"),
        text("bank_account_id").alias("bank"),
        names.alias("attachments"),
    )


def csv_line(columns: list[str]) -> Column:
    """Every cell quoted, quotes doubled, joined by ``;``."""
    quoted = [F.concat(F.lit('"'), F.regexp_replace(F.col(c), '"', '""'), F.lit('"')) for c in columns]
    return F.concat_ws(";", *quoted)


def write_export(rows: DataFrame, path: str) -> None:
    """Delimited files with a byte-order mark before the header of each part."""
    cols = [c for c in rows.columns if c != "entry_id"]
    titled = rows.select(*[F.col(c).alias((BOM if i == 0 else "") + t) for i, (c, t) in enumerate(zip(cols, EXPORT_TITLES))])
    titled.write.mode("overwrite").csv(path, sep=";", quoteAll=True, quote='"', escape='"', header=True)


def export_projection(ledger: DataFrame, chart: DataFrame) -> DataFrame:
    """The ten columns of the spreadsheet export."""
    return with_account_names(ledger, chart).select(
        "entry_id", "entry_date", "description", "debit_account", "debit_name", "credit_account", "credit_name",
        "amount", "category", "status", "bank_account_id",
    )


def report_entry_lines(ledger: DataFrame) -> DataFrame:
    """One formatted line per entry, with keys to order by."""
    line = F.concat(
        format_br_date("entry_date"), F.lit(" | R$ "), F.col("amount").cast("decimal(18,2)").cast("string"),
        F.lit(" | D:"), F.col("debit_account"), F.lit(" C:"), F.col("credit_account"),
        F.lit(" | "), F.col("description"), F.lit(" ["), F.col("category"), F.lit("]"),
    )
    return ledger.select("month", F.lit(2).alias("part"), F.col("entry_date").cast("string").alias("key1"),
                         F.col("entry_id").alias("key2"), line.alias("line"))


def report_summary_lines(summary: DataFrame) -> DataFrame:
    line = F.concat(
        F.col("bank_account_id"), F.lit(": entradas R$ "), F.col("inflow").cast("decimal(18,2)").cast("string"),
        F.lit(" | saídas R$ "), F.col("outflow").cast("decimal(18,2)").cast("string"),
    )
    return summary.select("month", F.lit(1).alias("part"), F.col("bank_account_id").alias("key1"),
                          F.lit(0).cast("long").alias("key2"), line.alias("line"))


# Titles of the text report's sections.
REPORT_TITLE, SUMMARY_TITLE, ENTRIES_TITLE = "RAZÃO - CONCILIAÇÃO", "--- RESUMO POR CONTA ---", "--- LANÇAMENTOS ---"


def report_header_lines(ledger: DataFrame, company: str, generated: str) -> DataFrame:
    """Title, company and month, time of making, and the two section titles, once for each month."""
    heads = [
        (0, "1", F.lit(REPORT_TITLE)), (0, "2", F.concat(F.lit(f"{company} | Competência: "), "month")), (0, "3", F.lit(f"Gerado em: {generated}")),
        (0, "4", F.lit("")), (0, "5", F.lit(SUMMARY_TITLE)), (2, "", F.lit("")), (2, "!", F.lit(ENTRIES_TITLE)),
    ]
    made = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(k).alias("key1"), F.lit(i - len(heads)).cast("long").alias("key2"), line.alias("line")) for i, (p, k, line) in enumerate(heads)])
    return ledger.select("month").distinct().select("month", F.inline(made))


def write_report(lines: DataFrame, path: str) -> None:
    """Text report, one folder per month, lines in order."""
    ordered = lines.repartitionByRange("month", "part", "key1", "key2").sortWithinPartitions("month", "part", "key1", "key2")
    ordered.select("month", "line").write.mode("overwrite").partitionBy("month").text(path)
