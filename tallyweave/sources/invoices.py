"""Invoice XML and the consolidated invoicing sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions.dates import parse_br_date
from tallyweave.functions.money import parse_reais
from tallyweave.functions.text import _c
from tallyweave.schemas import MONEY
from tallyweave.session import once

_PARTY = "STRUCT<CNPJ: STRING, CPF: STRING, xNome: STRING>"
_INFO = (
    "STRUCT<ide: STRUCT<nNF: STRING, `mod`: STRING, dhEmi: STRING>, "
    f"emit: {_PARTY}, dest: {_PARTY}, "
    "det: ARRAY<STRUCT<prod: STRUCT<CFOP: STRING>>>, "
    "total: STRUCT<ICMSTot: STRUCT<vNF: STRING, vICMS: STRING, vPIS: STRING, vCOFINS: STRING>>>"
)
# Either root: the processed envelope holds NFe, a bare NFe holds infNFe.
XML_SCHEMA = f"NFe STRUCT<infNFe: {_INFO}>, infNFe {_INFO}"


def read_invoice_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per XML file: path and whole text. Invoice files are single documents."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    )


def read_invoice_bundles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line of bundle files, a whole document on each line.

    Many small documents packed this way are split between tasks by size, and a damaged
    one costs itself only: an XML reader by row tag gives up the rest of its file.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml")).where(F.trim("xml") != "")


def _digits(party: str) -> Column:
    raw = F.coalesce(F.nullif(F.col(f"{party}.CNPJ"), F.lit("")), F.col(f"{party}.CPF"), F.lit(""))
    return F.regexp_replace(raw, r"\D", "")


def _int_text(x: str) -> Column:
    n = F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"^\s*(\d+)", 1)
    return F.when(n != "", F.regexp_replace(n, r"^0+(?=\d)", ""))


def _total(x: str) -> Column:
    """Zero and empty totals count as unknown."""
    v = _c(x).try_cast(MONEY)
    return F.when(v != 0, v)


def _parsed(files: DataFrame, xml: str) -> DataFrame:
    """``files`` with the record ``_r`` and its invoice ``_i``; a damaged text stands in ``_r._damaged``."""
    read = F.from_xml(xml, f"{XML_SCHEMA}, _damaged STRING", {"columnNameOfCorruptRecord": "_damaged"})
    return once(files, _r=read).withColumn("_i", F.when(F.col("_r._damaged").isNull(), F.coalesce("_r.NFe.infNFe", "_r.infNFe")))


def quarantined_invoices(files: DataFrame, xml: str = "xml") -> DataFrame:
    """Texts that give no invoice, with ``reason``: ``damaged`` (not well-formed) or ``no_invoice`` (another root, empty, null)."""
    reason = F.when(F.col("_r._damaged").isNotNull(), "damaged").otherwise("no_invoice")
    return _parsed(files, xml).where("_i IS NULL").select(*files.columns, reason.alias("reason"))


def parse_invoices(files: DataFrame, own_id: str, xml: str = "xml") -> DataFrame:
    """One row per readable invoice; other roots and malformed texts are dropped.

    Direction: inbound when the receiver is ``own_id``, else outbound. The
    counterparty is the other side.
    """
    info = _parsed(files, xml).where("_i IS NOT NULL")
    inbound = _digits("_i.dest") == own_id
    side = F.when(inbound, F.col("_i.emit")).otherwise(F.col("_i.dest"))
    keep = [c for c in files.columns if c != xml]
    return info.withColumn("_side", side).select(
        *keep,
        _int_text("_i.ide.nNF").alias("doc_number"),
        _int_text("_i.ide.mod").alias("doc_model"),
        F.nullif(F.get("_i.det", 0)["prod"]["CFOP"], F.lit("")).alias("cfop"),
        F.try_to_date(F.left("_i.ide.dhEmi", F.lit(10)), "yyyy-MM-dd").alias("issue_date"),
        F.col("_side.xNome").alias("counterparty_name"),
        F.coalesce("_side.CNPJ", "_side.CPF").alias("counterparty_doc"),
        F.when(inbound, "entrada").otherwise("saida").alias("direction"),
        _total("_i.total.ICMSTot.vNF").alias("total_value"),
        _total("_i.total.ICMSTot.vICMS").alias("icms_value"),
        _total("_i.total.ICMSTot.vPIS").alias("pis_value"),
        _total("_i.total.ICMSTot.vCOFINS").alias("cofins_value"),
        F.lit(False).alias("cancelled"),
        F.lit(None).cast("string").alias("payment_method"),
    )


# Column titles of the invoicing sheet.
SHEET_COLUMNS = {
    "doc_number": "Número Nota Fiscal",
    "doc_model": "Modelo",
    "cfop": "CFOP",
    "issue_date": "Emissão Eletrônica",
    "counterparty_name": "Nome da pessoa",
    "total_value": "Valor Total Geral",
    "icms_value": "Valor ICMS",
    "pis_value": "Valor PIS",
    "cofins_value": "Valor Cofins",
    "cancelled": "Docum. Cancelado",
}


def invoices_from_sheet(sheet: DataFrame) -> DataFrame:
    """Rows with a number, columns renamed, dates and ``R$`` money typed. All input columns are text."""

    def col(name: str) -> Column:
        return F.nullif(F.col(f"`{SHEET_COLUMNS[name]}`"), F.lit(""))

    return sheet.where(col("doc_number").isNotNull()).select(
        col("doc_number").alias("doc_number"),
        col("doc_model").alias("doc_model"),
        col("cfop").alias("cfop"),
        parse_br_date(F.left(col("issue_date"), F.lit(10))).alias("issue_date"),
        col("counterparty_name").alias("counterparty_name"),
        F.lit(None).cast("string").alias("counterparty_doc"),
        *[parse_reais(col(c)).alias(c) for c in ("total_value", "icms_value", "pis_value", "cofins_value")],
        col("cancelled").isNotNull().alias("cancelled"),
    )
