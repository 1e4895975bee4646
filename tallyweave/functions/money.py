"""Money parsing, cents and pt-BR formatting."""

from pyspark.sql import Column, functions as F

from tallyweave.functions.text import _c
from tallyweave.schemas import MONEY

# Tolerances in cents.
RECONCILE_CENTS = 2
LINK_CENTS = 5


def parse_money(x, decimal: str = ",") -> Column:
    """Numeric prefix of a money text; '' and null give 0, unparsable text gives null.

    With ``decimal=','`` every dot is a thousands mark and the first comma the decimal sign.
    """
    raw = F.coalesce(_c(x), F.lit(""))
    if decimal == ",":
        s = F.regexp_replace(F.regexp_replace(raw, r"\.", ""), r"^([^,]*),", "$1.")
    else:
        s = F.regexp_replace(raw, ",", "")
    num = F.regexp_extract(F.trim(s), r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1)
    return F.when(raw == "", F.lit(0).cast(MONEY)).otherwise(F.nullif(num, F.lit("")).try_cast(MONEY))


def parse_reais(x) -> Column:
    """``R$ 1.234,56`` to money; empty gives null."""
    raw = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"R\$", ""))
    return F.when(raw == "", F.lit(None).cast(MONEY)).otherwise(parse_money(raw))


def cents(x) -> Column:
    """Absolute amount as whole cents. Null stays null and so never matches."""
    return F.round(F.abs(_c(x)).cast("decimal(20,4)") * 100, 0).cast("long")


def format_brl(x) -> Column:
    """1234.5 to ``1.234,50``."""
    return F.translate(F.format_number(F.coalesce(_c(x), F.lit(0).cast(MONEY)), 2), ",.", ".,")


def tax_id(x) -> Column:
    """Digits only, left-padded to 14 (11 for a person); empty gives null."""
    d = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\D", "")
    width = F.when(F.length(d) <= 11, F.lit(11)).otherwise(F.lit(14))
    return F.when(d != "", F.when(width == 11, F.lpad(d, 11, "0")).otherwise(F.lpad(d, 14, "0")))
