"""Date and time-of-day helpers."""

from pyspark.sql import Column, functions as F

from tallyweave.functions.text import _c

NO_TIME_GAP = 9999  # fixed value: distance when either time is unknown


def try_date(year: Column, month: Column, day: Column) -> Column:
    """Calendar-checked date from text parts; null when invalid."""
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")


def parse_br_date(x) -> Column:
    """First ``DD/MM/YYYY`` or ``DD.MM.YYYY`` in the text."""
    p = r"(\d{2})[./](\d{2})[./](\d{4})"
    g = [F.regexp_extract(F.coalesce(_c(x), F.lit("")), p, i) for i in (1, 2, 3)]
    return try_date(g[2], g[1], g[0])


def month_of(x) -> Column:
    return F.date_format(_c(x), "yyyy-MM")


def month_folder(x) -> Column:
    """``YYYY-MM`` to the ``MM-YYYY`` folder name."""
    p = F.split(_c(x), "-")
    return F.concat_ws("-", p[1], p[0])


def minutes_in_text(x) -> Column:
    """First ``HH:MM`` or ``HH MM`` as minutes; null when absent."""
    p = r"(\d{2})[:\s](\d{2})"
    t = F.coalesce(_c(x), F.lit(""))
    h, m = F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)
    return F.when(h != "", h.cast("int") * 60 + m.cast("int"))


def minutes_gap(a, b) -> Column:
    return F.coalesce(F.abs(_c(a) - _c(b)), F.lit(NO_TIME_GAP))


def day_number(x) -> Column:
    """Days since 1970-01-01, for window keys."""
    return F.datediff(_c(x), F.lit("1970-01-01").cast("date"))


def format_br_date(x, empty: str = "") -> Column:
    return F.coalesce(F.date_format(_c(x), "dd/MM/yyyy"), F.lit(empty))
