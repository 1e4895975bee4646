"""Bank statements: three text layouts, one spreadsheet layout, one dispatcher.

All layouts are parsed in one pass over the lines by a CASE on the layout
column; rejected lines keep a reason and go to quarantine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyweave.functions.dates import month_of, parse_br_date
from tallyweave.functions.filenames import extension
from tallyweave.functions.money import parse_money
from tallyweave.functions.text import _c, normalize_space
from tallyweave.schemas import MONEY
from tallyweave.session import once

DATE_TEXT = r"\d{2}[./]\d{2}[./]\d{4}"
SKIPPED = "skipped"  # headers, balance lines, blank values: not data


@dataclass(frozen=True)
class Layout:
    """How to read one bank's lines. ``balance`` marks lines that only carry a balance."""

    name: str
    sep: str = ";"
    balance: str = r"(?iu)^\s*SALDO"
    decimal: str = ","


LAYOUT1_CSV = Layout("layout1", ",")
LAYOUT1_TXT = Layout("layout1", ";")
LAYOUT2 = Layout("layout2", ";", r"(?iu)Saldo Anterior|S A L D O")
LAYOUT3 = Layout("layout3", ";")
ANY_BALANCE = r"(?iu)SALDO"  # stricter variant: drops every history that mentions a balance


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files with their file and order; large files are split between tasks."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value"),
    )


def _fields(value: Column, sep: str) -> Column:
    """Fields between separators outside double quotes, without quotes and blanks.

    Lines with paired quotes are read in one pass; only the others need a look ahead at
    the quotes that follow.
    """
    paired = (F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 0
    plain = F.regexp_extract_all(F.concat(F.lit(sep), value), F.lit(f'{sep}((?:[^{sep}"]++|"[^"]*+")*+)'), F.lit(1))
    odd = F.split(value, f'{sep}(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(F.when(paired, plain).otherwise(odd), lambda p: F.trim(F.regexp_replace(F.trim(p), '^"|"$', "")))


def _nth(parts: Column, i: int) -> Column:
    return F.coalesce(F.get(parts, i), F.lit(""))


_RAW = "struct<date_text:string,description:string,counterparty:string,counterparty_doc:string,amount_text:string,sign:int,external_ref:string,skip:boolean>"


def _raw(date_text: Column, desc: Column, cp, doc, amount: Column, ref, skip: Column, sign=None) -> Column:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    fields = (date_text, desc, text(cp), text(doc), amount, F.lit(None).cast("int") if sign is None else sign, text(ref), skip)
    return F.struct(*fields).cast(_RAW)


def _layout1(p: Column, layout: Layout) -> Column:
    """date, history, name, tax id, value[, balance]; short form date, history, value."""
    long_form = F.size(p) >= 5
    raw = F.when(long_form, _nth(p, 4)).otherwise(_nth(p, 2))
    skip = (F.size(p) < 3) | _nth(p, 1).rlike(layout.balance) | (raw == "")
    return _raw(_nth(p, 0), _nth(p, 1), F.when(long_form, _nth(p, 2)).otherwise(""), F.when(long_form, _nth(p, 3)).otherwise(""), raw, "", skip)


def _layout2(p: Column, layout: Layout) -> Column:
    """Column 3 date, 7 reference, 9 history, 10 value, 11 D/C sign, 12 detail."""
    skip = (F.size(p) < 10) | _nth(p, 9).rlike(layout.balance)
    desc = F.trim(F.concat(_nth(p, 9), F.lit(" "), _nth(p, 12)))
    return _raw(_nth(p, 3), desc, _nth(p, 12), "", _nth(p, 10), _nth(p, 7), skip, F.when(_nth(p, 11) == "D", -1))


def _layout3(p: Column, layout: Layout) -> Column:
    """date; description; value. The counterparty follows a dash and a letter."""
    desc = F.trim(F.regexp_replace(_nth(p, 1), '"', ""))
    cp = F.trim(F.regexp_extract(desc, '(?iu)-([A-ZÀ-Ú][^"]+)$', 1))
    return _raw(_nth(p, 0), desc, cp, "", _nth(p, 2), "", F.size(p) < 3)


def _typed(rows: DataFrame, decimal: str) -> DataFrame:
    """Dates, amounts and the reason of rejection from the struct column ``_raw``."""
    typed = once(rows, _date=parse_br_date(F.col("_raw.date_text")), _amount=F.when(F.col("_raw.amount_text").isNotNull(), parse_money(F.col("_raw.amount_text"), decimal)))
    skipped = ~F.col("_raw.date_text").rlike(DATE_TEXT) | F.col("_raw.skip")
    reason = F.when(skipped, SKIPPED).when(F.col("_date").isNull(), "bad_date").when(F.col("_amount").isNull(), "bad_amount")
    text = lambda c: F.nullif(F.col(f"_raw.{c}"), F.lit(""))
    out = {
        "tx_date": F.col("_date"), "description": F.col("_raw.description"), "counterparty": text("counterparty"), "counterparty_doc": text("counterparty_doc"),
        "amount": F.when(F.col("_raw.sign") == -1, -F.abs("_amount")).otherwise(F.col("_amount")).cast(MONEY), "external_ref": text("external_ref"), "reason": reason}
    return typed.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_raw" and c not in out], *[c.alias(n) for n, c in out.items()])


LAYOUTS = {"layout1": LAYOUT1_CSV, "layout1_txt": LAYOUT1_TXT, "layout2": LAYOUT2, "layout3": LAYOUT3}
_READERS = {"layout1": _layout1, "layout1_txt": _layout1, "layout2": _layout2, "layout3": _layout3}


def parse_lines(lines: DataFrame, layout: Column, value: str = "value", layouts: dict[str, Layout] | None = None) -> DataFrame:
    """``lines`` with the parsed fields and ``reason``; ``layout`` names each line's layout, null for none.

    Every line is cleaned, split and typed once. ``layouts`` replaces the standard ones.
    """
    layouts = layouts or LAYOUTS
    clean = once(lines, _layout=layout, _v=F.coalesce(normalize_space(F.col(value)), F.lit("")))
    separators = {n: x.sep for n, x in layouts.items() if n != "layout3"}
    fields = F.when(F.col("_layout") == "layout3", F.split("_v", layouts.get("layout3", LAYOUT3).sep))
    for sep in sorted(set(separators.values())):
        fields = fields.when(F.col("_layout").isin([n for n, s in separators.items() if s == sep]), _fields(F.col("_v"), sep))
    split = once(clean, _f=fields)
    raw = F.lit(None).cast(_RAW)
    for name, form in layouts.items():
        raw = F.when(F.col("_layout") == name, _READERS[name](F.col("_f"), form)).otherwise(raw)
    typed = _typed(once(split.withColumn("_raw", F.lit(None)), _raw=raw).drop("_f", "_v"), ",")
    return typed.withColumn("reason", F.when(F.col("_layout").isNull(), "no_layout").otherwise(F.col("reason"))).drop("_layout")


def parse_sheet(cells: DataFrame, columns: tuple[str, ...] = ("c0", "c1", "c2", "c3", "c4"), layout: Layout = LAYOUT1_CSV) -> DataFrame:
    """The five positional columns of the spreadsheet form of layout 1."""
    t = [F.coalesce(normalize_space(F.col(c)), F.lit("")) for c in columns]
    clean = once(cells, **{f"_t{i}": c for i, c in enumerate(t)})
    c = [F.col(f"_t{i}") for i in range(5)]
    skip = (c[1] == "") | c[1].rlike(layout.balance) | (c[4] == "")
    rows = once(clean.withColumn("_raw", F.lit(None)), _raw=_raw(c[0], c[1], c[2], c[3], c[4], "", skip))
    return _typed(rows.drop(*columns, *[f"_t{i}" for i in range(5)]), layout.decimal)


def layout_of(account, path, prefixes: dict[str, str]) -> Column:
    """Layout name by account-id prefix; layout 1 text files use their own separator. Null when unknown."""
    out = F.lit(None).cast("string")
    for prefix, layout in prefixes.items():
        out = F.when(_c(account).startswith(prefix), F.lit(layout)).otherwise(out)
    return F.when((out == "layout1") & (extension(path) == ".txt"), "layout1_txt").otherwise(out)


def parse_statements(lines: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Parse lines carrying ``path`` and ``bank_account_id`` by their account's layout, in one pass."""
    named = lines.withColumn("layout", layout_of("bank_account_id", "path", prefixes))
    return parse_lines(named, F.col("layout"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").drop("reason", "value", "layout").withColumn("month", month_of("tx_date"))


def quarantined(parsed: DataFrame) -> DataFrame:
    """Lines that carry data but could not be read, with the reason."""
    return parsed.where(F.col("reason").isNotNull() & (F.col("reason") != SKIPPED)).select("path", "value", "reason")


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` (``path, block, pos``) with ``line_no``, from 0 in each file.

    Each block counts its own lines; only the blocks' counts, few for a file, are summed
    in order, so a large file is never gathered in one task.
    """
    blocks = lines.groupBy("path", "block").agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    bases = blocks.select("path", "block", "_first", F.coalesce(before, F.lit(0)).alias("_base"))
    return lines.join(bases, ["path", "block"]).withColumn("line_no", F.col("_base") + F.col("pos") - F.col("_first")).drop("_base", "_first")


def file_fingerprints(lines: DataFrame) -> DataFrame:
    """One row per file and account with a fingerprint of the content in its order, by partial aggregation.

    Three independent figures over all lines, each line hashed with the text before it in
    the order of ``line_no``; a large file is never gathered in one task. Files of two
    accounts never share a fingerprint.
    """
    h = F.xxhash64("value", "line_no")
    return lines.groupBy("path", "bank_account_id").agg(
        F.concat_ws(
            "-",
            F.col("bank_account_id"),
            F.count("*").cast("string"),
            F.hex(F.bit_xor(h)),
            F.sum(h.cast("decimal(38,0)")).cast("string"),
            F.sum(F.crc32("value").cast("decimal(38,0)") * (F.col("line_no") + 1)).cast("string"),
        ).alias("hash")
    )


def first_copies(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Keep one path per content hash, the first by path, and none already in ``known``."""
    one = files.groupBy("hash").agg(F.min("path").alias("path"))
    return one if known is None else one.join(known.select("hash"), "hash", "left_anti")


def duplicate_hashes(files: DataFrame) -> DataFrame:
    return files.groupBy("hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")


def with_line_ids(lines: DataFrame, batch: int = 0) -> DataFrame:
    """``lines`` (``path, line_no``) with a long ``tx_id`` that a repeated run gives again.

    Files follow each other by path, lines by number; a batch has 2^40 ids of its own.
    """
    files = lines.groupBy("path").agg((F.max("line_no") + 1).alias("_n"))
    before = F.sum("_n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1))  # one row for each file
    bases = files.select("path", (F.coalesce(before, F.lit(0)) + F.lit(batch << 40)).alias("_base"))
    return lines.join(bases, "path").withColumn("tx_id", F.col("_base") + F.col("line_no")).drop("_base")
