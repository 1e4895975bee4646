"""Table schemas. Money is decimal(18,2), dates are DateType, ``month`` is YYYY-MM."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_str, _long, _date, _bool, _dbl = T.StringType(), T.LongType(), T.DateType(), T.BooleanType(), T.DoubleType()

CHART_OF_ACCOUNTS = _s(("code", _str), ("name", _str), ("type", _str))
BANK_ACCOUNTS = _s(
    ("bank_account_id", _str), ("bank", _str), ("agency", _str), ("account_number", _str),
    ("coa_code", _str), ("active", _bool),
)
SOURCE_FILES = _s(
    ("file_id", _str), ("path", _str), ("kind", _str), ("bank_account_id", _str),
    ("month", _str), ("imported_at", T.TimestampType()), ("hash", _str),
)
TRANSACTIONS = _s(
    ("tx_id", _long), ("file_id", _str), ("bank_account_id", _str), ("tx_date", _date), ("description", _str),
    ("counterparty", _str), ("counterparty_doc", _str), ("amount", MONEY), ("external_ref", _str), ("raw_json", _str),
)
LEDGER = _s(
    ("entry_id", _long), ("tx_id", _long), ("entry_date", _date), ("description", _str), ("debit_account", _str),
    ("credit_account", _str), ("amount", MONEY), ("category", _str), ("status", _str), ("month", _str),
)
FISCAL = _s(
    ("fiscal_id", _long), ("file_id", _str), ("doc_number", _str), ("doc_model", _str), ("cfop", _str),
    ("issue_date", _date), ("counterparty_name", _str), ("counterparty_doc", _str), ("direction", _str),
    ("total_value", MONEY), ("icms_value", MONEY), ("pis_value", MONEY), ("cofins_value", MONEY),
    ("cancelled", _bool), ("payment_method", _str),
)
RECONCILIATIONS = _s(
    ("tx_id", _long), ("fiscal_id", _long), ("match_type", _str), ("match_score", _dbl), ("confirmed", _bool),
)
ATTACHMENTS = _s(
    ("entry_id", _long), ("file_path", _str), ("file_name", _str), ("file_type", _str), ("file_size", _long),
    ("match_type", _str), ("match_score", _dbl), ("stage", _str),
)
RULES = _s(
    ("priority", T.IntegerType()), ("pattern", _str), ("category", _str), ("counter_account", _str), ("nature", _str),
)

# Enum domains.
ACCOUNT_TYPES = ("ativo", "passivo", "receita", "despesa", "patrimonio")
LEDGER_STATUS = ("matched", "pending", "manual_review")
CATCH_ALL = "9.9.9.99"
