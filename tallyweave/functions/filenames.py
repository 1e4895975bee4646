"""What a file path tells: extension, kind, bank account, embedded date and amount."""

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.dates import try_date
from tallyweave.functions.money import parse_money
from tallyweave.functions.text import _c

# Extension sets and skipped names.
ATTACHMENT_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".tiff", ".tif", ".txt", ".xml")
STATEMENT_EXTENSIONS = (".csv", ".txt", ".xlsx", ".xls", ".ofx")
FUEL_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff")
SKIPPED_FOLDERS = ("node_modules", ".git")
SKIPPED_FILES = r"(?i)^(desktop\.ini|thumbs\.db)$"
ATTACHABLE_KINDS = ("comprovante", "anexo", "nota_fiscal", "boleto", "fatura_cartao", "xml_nfe")


# Forms of file names and folders, and the words that name a kind of file.
SLIP = r"(\d+)\s*-\s*(\d{2})(\d{2})(\d{4})\s*-\s*([^-]+)\s*-\s*([\d.,]+)"
ISO_DATE = r"(\d{4})-(\d{2})-(\d{2})"
TRANSFER_NAME = r"(?i)_([^_]+)\.pdf$"
SCAN = r"(?i)Scan_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})"
DIGITALIZED = r"(?i)Digitalizado_(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})"
FULL_DATE = r"(\d{2})(\d{2})(\d{4})"
MONTH_ONLY = r"(\d{2})(\d{4})"
DANFE_PATH = r"XML\s+\d{2}-\d{4}|/NFE/|/NFCE/|\d{44}\.PDF$"
SLIP_START = r"^\d+ - \d{8}"
INVOICE_KEY = r"(\d{44})"
KIND_WORDS = {"extrato": "EXTRATO", "xml_nfe": "XML", "combustivel": "COMBUST", "comprovante": "COMPROVANTE", "boleto": "BOLETO"}


def slashes(path) -> Column:
    return F.translate(_c(path), "\\", "/")


def base_name(path) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def extension(path) -> Column:
    """Lower-case extension with its dot; '' when there is none. A leading dot is not an extension."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.]+.*(\.[^.]*)$", 1))


def file_kind(path) -> Column:
    """Ordered classification of a path; the first case that holds wins."""
    p, base, ext = F.upper(slashes(path)), base_name(path), extension(path)
    return (
        F.when((ext == ".pdf") & p.rlike(DANFE_PATH), "danfe")
        .when(ext.isin(*STATEMENT_EXTENSIONS) & F.upper(base).contains(KIND_WORDS["extrato"]), "extrato")
        .when(ext == ".xml", "xml_nfe")
        .when(p.contains(KIND_WORDS["xml_nfe"]), "xml_nfe")
        .when(p.contains(KIND_WORDS["combustivel"]), "combustivel")
        .when(p.contains(KIND_WORDS["comprovante"]) | base.rlike(SLIP_START), "comprovante")
        .when(p.contains("NOTA FISCAL") | p.contains("NOTAS FISCAL"), "nota_fiscal")
        .when(p.contains("FATURA CART") | p.contains("FATURA-INTER"), "fatura_cartao")
        .when(p.contains(KIND_WORDS["boleto"]), "boleto")
        .when(ext.isin(*ATTACHMENT_EXTENSIONS), "anexo")
        .otherwise("outro")
    )


def indexable(path) -> Column:
    """Files the inventory keeps: known extension, not under a skipped folder."""
    skipped = "|".join(d.replace(".", r"\.") for d in SKIPPED_FOLDERS)
    return (
        extension(path).isin(*sorted(set(ATTACHMENT_EXTENSIONS) | set(STATEMENT_EXTENSIONS)))
        & ~slashes(path).rlike(f"(^|/)({skipped})/")
    )


def path_rule_column(path, rules: list[tuple[str, str, str]]) -> Column:
    """First ``(pattern, account_id, coa_code)`` found in the upper-case path, as a struct; else null.

    The list is the user's ordered folder map; it is folded into one CASE.
    """
    p = F.upper(_c(path))
    out = F.lit(None).cast("struct<bank_account_id:string,coa_code:string>")
    for pattern, account, coa in reversed(rules):
        hit = F.struct(F.lit(account).alias("bank_account_id"), F.lit(coa).alias("coa_code"))
        out = F.when(p.rlike(pattern), hit).otherwise(out)
    return out


def with_bank_by_path(files: DataFrame, rules: list[tuple[str, str, str]], path: str = "path") -> DataFrame:
    hit = path_rule_column(path, rules)
    return files.withColumn("_b", hit).select("*", F.col("_b.bank_account_id"), F.col("_b.coa_code")).drop("_b")


def slip_meta(name) -> Column:
    """``n - DDMMYYYY - type - amount``: date, type, amount, is_payment; null when the name has another form."""
    n = F.coalesce(_c(name), F.lit(""))
    g = [F.regexp_extract(n, SLIP, i) for i in range(7)]
    return F.when(
        g[0] != "",
        F.struct(
            try_date(g[4], g[3], g[2]).alias("date"),
            F.trim(g[5]).alias("type"),
            parse_money(g[6]).alias("amount"),
            F.lower(g[5]).contains("pagamento").alias("is_payment"),
        ),
    )


def transfer_meta(name) -> Column:
    """First ISO date in the name and the last ``_Name.pdf`` part."""
    n = F.coalesce(_c(name), F.lit(""))
    who = F.regexp_extract(n, TRANSFER_NAME, 1)
    return F.struct(
        try_date(*[F.regexp_extract(n, ISO_DATE, i) for i in (1, 2, 3)]).alias("date"),
        F.when(who != "", who).alias("counterparty"),
    )


def fuel_meta(name, modified=None) -> Column:
    """Receipt date and time from five name forms, in order; the last falls back on the file time."""
    n = F.coalesce(_c(name), F.lit(""))
    mod = F.lit(None).cast("date") if modified is None else _c(modified).cast("date")

    def g(p: str, k: int) -> list[Column]:
        return [F.regexp_extract(n, p, i) for i in range(k + 1)]

    scan, digi, full, part = g(SCAN, 6), g(DIGITALIZED, 5), g(FULL_DATE, 3), g(MONTH_ONLY, 2)
    day = F.coalesce(F.date_format(mod, "dd"), F.lit("01"))
    no_time = F.lit(None).cast("string")

    def s(d: Column, t: Column) -> Column:
        return F.struct(d.alias("doc_date"), t.alias("doc_time"))

    return (
        F.when(scan[0] != "", s(try_date(scan[1], scan[2], scan[3]), F.concat_ws(":", scan[4], scan[5])))
        .when(digi[0] != "", s(try_date(digi[1], digi[2], digi[3]), F.concat_ws(":", digi[4], digi[5])))
        .when(full[0] != "", s(try_date(full[3], full[2], full[1]), no_time))
        .when(part[0] != "", s(try_date(part[2], part[1], day), no_time))
        .otherwise(s(mod, no_time))
    )


def invoice_key(path) -> Column:
    """The 44-digit invoice key in a path, else null."""
    k = F.regexp_extract(F.coalesce(_c(path), F.lit("")), INVOICE_KEY, 1)
    return F.when(k != "", k)


def content_id(x) -> Column:
    return F.sha1(_c(x))


def path_id(path, modified) -> Column:
    """sha1 of path and file time; the 16-character prefix is used for fuel receipts."""
    return F.sha1(F.concat(_c(path), _c(modified).cast("string")))
