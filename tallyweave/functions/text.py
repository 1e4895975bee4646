"""Text and name normalisation."""

from pyspark.sql import Column, functions as F

# Accented letters and their plain forms (Latin-1 and Latin Extended-A, upper case).
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸĀĂĄĆĈĊČĎĒĔĖĘĚĜĞĠĢĤĨĪĬĮİĴĶĹĻĽŃŅŇŌŎŐŔŖŘŚŜŞŠŢŤŨŪŬŮŰŲŴŶŹŻŽ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYYAAACCCCDEEEEEGGGGHIIIIIJKLLLNNNOOORRRSSSSTTUUUUUUWYZZZ"

# Combining marks dropped after decomposition.
_MARKS = r"[̀-ͯ]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_upper(x) -> Column:
    """Upper case without diacritics."""
    return F.regexp_replace(F.translate(F.upper(_c(x)), ACCENTED, PLAIN), _MARKS, "")


def normalize_name(x) -> Column:
    """Upper case, no diacritics, only A-Z and 0-9; null becomes ''."""
    return F.regexp_replace(fold_upper(F.coalesce(_c(x), F.lit(""))), "[^A-Z0-9]", "")


def normalize_space(x) -> Column:
    """No-break spaces to plain spaces, trimmed. Applied once on ingest."""
    return F.trim(F.translate(_c(x), " ", " "))


# Forms of payer names in bank histories.
PAYER_DATED = r"(?iu)Pix\s*-\s*Recebido\s+(?:\d{2}/\d{2}\s+\d{2}:\d{2}\s+)?\d{11,14}\s+(.+)$"
PAYER_PLAIN = r"(?iu)Pix\s*-\s*Recebido\s+(.+)$"
PAYER_AFTER = r"(?iu)(?:Cp\s*:|Recebido\s+)(?:\d+-)?([A-ZÀ-Ú][A-ZÀ-Ú\s]+)"
PAYER_PREFIX = r"^\d{2}/\d{2}.*?\d{11,14}\s+"
PAYER_TAIL = r"^(.*?)(?:\s+\d{2}/\d{2}.*)?$"


def client_name(description, counterparty, own_company: Column, partner: Column) -> Column:
    """Readable payer name from a bank history line; null for own company and partners."""
    cp = F.coalesce(_c(counterparty), F.lit(""))
    hay = F.trim(F.concat(F.coalesce(_c(description), F.lit("")), F.lit(" "), cp))
    plain_hit = F.regexp_extract(hay, PAYER_PLAIN, 1)
    fallback = F.trim(F.regexp_replace(cp, PAYER_PREFIX, ""))
    name = (
        F.when(hay.rlike(PAYER_DATED), F.trim(F.regexp_extract(F.regexp_extract(hay, PAYER_DATED, 1), PAYER_TAIL, 1)))
        .when((plain_hit != "") & ~plain_hit.rlike(r"^\d"), F.trim(plain_hit))
        .when(hay.rlike(PAYER_AFTER), F.trim(F.regexp_extract(hay, PAYER_AFTER, 1)))
        .otherwise(F.when(fallback != "", fallback))
    )
    return F.when(own_company | partner, F.lit(None).cast("string")).otherwise(name)


def supplier_name(description, counterparty) -> Column:
    """Counterparty, else the text after ``Cp :digits-``."""
    tail = F.trim(F.regexp_extract(F.coalesce(_c(description), F.lit("")), r"(?iu)Cp\s*:\d+-(.+)$", 1))
    return F.coalesce(F.when(_c(counterparty) != "", _c(counterparty)), F.when(tail != "", tail))


def station_name(description, counterparty) -> Column:
    """Counterparty, else the history from its last POSTO on."""
    desc = F.regexp_replace(_c(description), r"(?iu).*POSTO", "POSTO")
    return F.coalesce(F.when(_c(counterparty) != "", _c(counterparty)), F.when(desc != "", desc))


def matches_any(text, patterns: list[str]) -> Column:
    """True where any of the given patterns is found; null text counts as ''."""
    t = F.coalesce(_c(text), F.lit(""))
    out = F.lit(False)
    for p in patterns:
        out = out | t.rlike(f"(?iu){p}")
    return out


def partner_lookup(text, partners: list[tuple[str, str]]) -> Column:
    """Name of the first partner ``(pattern, name)`` found in the text, else null."""
    t = F.coalesce(_c(text), F.lit(""))
    out = F.lit(None).cast("string")
    for pattern, name in reversed(partners):
        out = F.when(t.rlike(f"(?iu){pattern}"), F.lit(name)).otherwise(out)
    return out


def clean_account_name(x) -> Column:
    """Drop asterisks, collapse blanks, drop leading figures."""
    s = F.regexp_replace(_c(x), r"\*+", "")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(F.regexp_replace(s, r"^[\d.,\s]+", ""))


def valid_account_name(x) -> Column:
    """2-120 characters, at most 30 % digits, at least one letter."""
    s = _c(x)
    digits = F.regexp_count(s, F.lit(r"\d"))
    return F.coalesce(
        F.length(s).between(2, 120)
        & ~s.rlike(r"^[\d.,\s]+$")
        & (digits <= F.length(s) * F.lit(0.3))
        & s.rlike("[A-Za-zÀ-ú]"),
        F.lit(False),
    )


def accounts_search_key(code, name) -> Column:
    """Lower-case accent-free haystack for account lookup."""
    return F.lower(fold_upper(F.concat_ws(" ", _c(code), _c(name))))


def all_tokens(haystack: Column, query: str) -> Column:
    """Every blank-separated token of ``query`` occurs in the normalised haystack."""
    q = F.lower(fold_upper(F.lit(query)))
    return F.forall(F.split(q, r"\s+"), lambda t: haystack.contains(t))


def attachment_key(*parts) -> Column:
    """Letters and digits of the joined parts, at most 40 characters."""
    return F.left(F.regexp_replace(F.concat_ws("-", *[_c(p) for p in parts]), "(?i)[^a-z0-9]", ""), F.lit(40))
