"""Account-code helpers."""

from pyspark.sql import Column, functions as F

from tallyweave.functions.text import _c
from tallyweave.schemas import CATCH_ALL

# Fuel account prefix, fuel words, words that mark equity accounts.
FUEL_PREFIX = "4.02.01.01.06"
FUEL_DEFAULT_ACCOUNT = "4.02.01.01.06.0001"
# Whether a fuel receipt found its entry.
LINKED, UNLINKED = "conciliado", "documento"
FUEL_WORDS = r"POSTOS?\s|POSTO\s|COMBUST|LUBRIFIC|GASOLINA|DIESEL|ABASTEC"
EQUITY_WORDS = r"PATRIM|CAPITAL SOCIAL|LUCRO|PREJU|RESULTADO"


def account_type(code, name, section=None) -> Column:
    """Equity by keyword, else by the first figure of the code."""
    text = F.concat_ws(" ", _c(name), F.lit("") if section is None else _c(section))
    head = F.left(_c(code), F.lit(2))
    return (
        F.when(F.upper(text).rlike(EQUITY_WORDS), "patrimonio")
        .when(head == "1.", "ativo")
        .when(head == "2.", "passivo")
        .when(head == "3.", "receita")
        .when(head == "4.", "despesa")
        .otherwise("patrimonio")
    )


def code_sort_key(code) -> Column:
    """Numeric-aware sort key: the code's parts as integers."""
    return F.transform(F.split(_c(code), r"\."), lambda p: p.try_cast("int"))


def unclassified(debit="debit_account", credit="credit_account", category="category", status="status") -> Column:
    return (
        (_c(status) == "manual_review")
        | (_c(debit) == CATCH_ALL)
        | (_c(credit) == CATCH_ALL)
        | F.coalesce(_c(category), F.lit("")).rlike("(?iu)não classificado")
    )


def pending_side(debit="debit_account", credit="credit_account") -> Column:
    """Side still on the catch-all account, debit first; else null."""
    return F.when(_c(debit) == CATCH_ALL, "debit").when(_c(credit) == CATCH_ALL, "credit")


def posting_account(debit="debit_account", credit="credit_account", bank_coa="bank_coa") -> Column:
    """The account opposite the bank: debit unless catch-all or the bank itself, else credit unless catch-all."""
    d, c = _c(debit), _c(credit)
    return F.when((d != CATCH_ALL) & ~d.eqNullSafe(_c(bank_coa)), d).when(c != CATCH_ALL, c)


def fuel_entry(debit="debit_account", category="category", description="description", counterparty="counterparty") -> Column:
    """Fuel by account prefix, category or words in the text (reporting predicate)."""
    text = F.concat(F.coalesce(_c(description), F.lit("")), F.lit(" "), F.coalesce(_c(counterparty), F.lit("")))
    return (
        F.coalesce(_c(debit).startswith(FUEL_PREFIX), F.lit(False))
        | F.coalesce(F.lower(_c(category)).contains("combust"), F.lit(False))
        | text.rlike(f"(?iu){FUEL_WORDS}")
    )


def fuel_linkable(debit="debit_account", category="category", description="description", counterparty="counterparty") -> Column:
    """Fuel predicate of the linking stage: narrower words, each column on its own."""

    def has(x, word: str) -> Column:
        return F.coalesce(_c(x).ilike(f"%{word}%"), F.lit(False))

    return (
        F.coalesce(_c(debit).startswith(FUEL_PREFIX), F.lit(False))
        | has(category, "combust")
        | has(description, "POSTO")
        | has(description, "COMBUST")
        | has(counterparty, "POSTO")
    )


# Operation codes that are not sales (dispatch, return, refund).
NON_SALE_CODES = ("5551", "5552", "5922", "5923", "5929", "5949")


def sale_document(cancelled="cancelled", cfop="cfop") -> Column:
    return ~F.coalesce(_c(cancelled), F.lit(False)) & ~F.coalesce(_c(cfop), F.lit("")).isin(*NON_SALE_CODES)
