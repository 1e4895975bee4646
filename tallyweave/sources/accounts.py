"""Chart of accounts: seed file and extraction from trial-balance text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyweave.functions.accounts import account_type
from tallyweave.functions.text import clean_account_name, valid_account_name
from tallyweave.operators.ranking import ranked
from tallyweave.schemas import CHART_OF_ACCOUNTS
from tallyweave.session import cut

# The account-code form, line forms, and lines that carry no account.
CODE = r"[1-5]\.\d{2}(?:\.\d{2}){1,5}(?:\.\d{4})?"
CODE_LINE = rf"^({CODE})\s+[\d.,]"
GLUED_LINE = rf"^(.+?)({CODE})\s+[\d.,]"
ANYWHERE = rf"({CODE})\s+[\d.,]+"
NAME_THEN_CODE = rf"(?i)([A-ZÀ-Úa-zà-ú][A-Za-zÀ-ú0-9 &./\-]{{2,100}}?)({CODE})\s+[\d.,]"
SKIP_LINE = (
    r"(?iu)^(Folha:|Empresa:|CNPJ:|Período:|IE:|Junta|Local|Data|Número|Endereço|Descrição|Conta|Débito|Crédito|"
    r"Saldo|ATIVOPASSIVO|PROSIS|BALANCETE|BALANÇO)"
)
SECTION_LINE = r"^\* \* \*"
SHEET_TITLE = r"(?iu)BALANÇO PATRIMONIAL"
UNCLASSIFIED_ACCOUNT = ("9.9.9.99", "Conta a classificar (revisão manual)", "despesa")
BACK, FORWARD = 6, 4  # lines looked at before and after a code line
BLOCK = 1 << 16  # lines per block; a report of any length is split between tasks


def write_chart(chart: DataFrame, path: str) -> None:
    """The chart as one JSON array in one file: it has as many rows as a company has accounts."""
    one = chart.select(F.struct("code", "name", "type").alias("a")).agg(F.to_json(F.sort_array(F.collect_list("a"))).alias("value"))
    one.coalesce(1).write.text(path)


def read_chart(spark: SparkSession, path: str) -> DataFrame:
    """The seed file: one JSON array of {code, name, type}."""
    return spark.read.schema(CHART_OF_ACCOUNTS).json(path, multiLine=True)


def _with_section(lines: DataFrame) -> DataFrame:
    """Latest section header at or before each line: inside its block, else from the blocks before."""
    inside = W.partitionBy("report_id", "block").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(SECTION_LINE), F.col("line"))
    marked = lines.withColumn("_s", F.last(head, ignorenulls=True).over(inside))
    last = marked.groupBy("report_id", "block").agg(F.max_by("_s", "i").alias("_end"))
    before = W.partitionBy("report_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select("report_id", "block", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    return marked.join(carry, ["report_id", "block"]).withColumn(
        "section", F.coalesce("_s", "_carry", F.lit(""))
    ).drop("_s", "_carry")


def _neighbours(lines: DataFrame) -> DataFrame:
    """The cleaned lines around each line, nearest first.

    Each block is read with a copy of the lines beside it, so blocks need no
    other rows; copies are dropped afterwards.
    """
    copies = lines.withColumn(
        "_b",
        F.explode(
            F.array_distinct(
                F.array(
                    F.col("block"),
                    F.floor((F.col("i") - FORWARD - 1) / BLOCK),
                    F.floor((F.col("i") + BACK - 1) / BLOCK),
                )
            )
        ),
    )
    item = F.struct("line", "glued_name", "glued_code", "stops", "part")
    order = W.partitionBy("report_id", "_b").orderBy("i")
    back = F.collect_list(item).over(order.rowsBetween(-BACK, -1))
    ahead = F.collect_list(item).over(order.rowsBetween(1, FORWARD))
    return (
        copies.withColumn("back", F.reverse(back)).withColumn("ahead", ahead)
        .where(F.col("_b") == F.col("block")).drop("_b")
    )


def _until_stop(items: Column) -> Column:
    """Items before the first one that ends the search."""
    stop = F.array_position(F.transform(items, lambda x: x["stops"]), True)
    return F.when(stop > 0, F.slice(items, F.lit(1), stop.cast("int") - 1)).otherwise(items)


def extract_accounts(report_lines: DataFrame, known: list[tuple[str, str]] = ()) -> DataFrame:
    """Accounts named in trial-balance lines ``(report_id, line_no, line)``.

    A code glued after a name takes that name. A code alone takes its name from
    valid lines before it (joined in reading order), else from the next valid
    line, else from the section header, else keeps the code as its name. Per
    report and code the longest name wins, ties to the earlier line. Codes
    still without a name are tried twice more: a name printed right before the
    code inside any line, then the lines around a code line, first hit each.
    ``known`` names override.
    """
    text = report_lines.select("report_id", "line_no", F.trim("line").alias("line")).where("line <> ''")
    line = F.col("line")
    glued_name = clean_account_name(F.regexp_extract(line, GLUED_LINE, 1))
    glued_code = F.nullif(F.regexp_extract(line, GLUED_LINE, 2), F.lit(""))
    code = F.nullif(F.regexp_extract(line, CODE_LINE, 1), F.lit(""))
    skip = line.rlike(SKIP_LINE) | line.rlike(SECTION_LINE)
    analytic = glued_code.isNotNull() | F.coalesce(code.rlike(r"\.\d{4}$"), F.lit(False))
    lines = (
        ranked(text, ["report_id"], "line_no", "i")
        .withColumn("block", F.floor((F.col("i") - 1) / BLOCK))
        .withColumn("glued_name", F.when(glued_code.isNotNull(), glued_name))
        .withColumn("glued_code", glued_code)
        .withColumn("code", F.when(~skip, code))
        .withColumn("stops", skip | analytic)
        .withColumn("part", F.when(valid_account_name(clean_account_name(line)), clean_account_name(line)))
        .withColumn("skip", skip)
    )
    ctx = _neighbours(_with_section(lines))
    names_back = F.filter(F.transform(_until_stop(F.col("back")), lambda x: x["part"]), lambda p: p.isNotNull())
    back_name = clean_account_name(F.array_join(F.reverse(names_back), " "))

    def ahead_hit(x: Column) -> Column:
        glued = x["glued_code"].startswith(F.col("code")) & valid_account_name(x["glued_name"])
        return F.when(glued, x["glued_name"]).when(~x["stops"], x["part"])

    # The first following line that either names the account or stops the search.
    ahead = F.transform(F.col("ahead"), lambda x: F.struct(ahead_hit(x).alias("name"), x["stops"].alias("stops")))
    first = F.get(F.filter(ahead, lambda x: x["name"].isNotNull() | x["stops"]), 0)["name"]
    near_name = F.when(valid_account_name(back_name), back_name).when(valid_account_name(first), first)
    section = F.trim(F.regexp_replace("section", r"\*+", ""))
    fallback = F.when((F.length(section) > 3) & valid_account_name(section), section)
    columns = ["report_id", "code", "name", "section", "i"]
    codes = cut(
        ctx.where("code IS NOT NULL OR glued_code IS NOT NULL").select(
            "report_id", "i", "skip", "section", "glued_code", "glued_name", "code",
            near_name.alias("near"), fallback.alias("fallback")),
        "account-lines",
    )
    from_code = codes.where("code IS NOT NULL AND glued_code IS NULL").withColumn("name", F.coalesce("near", "fallback", "code")).select(columns)
    from_glued = codes.where(F.col("glued_code").isNotNull() & ~F.col("skip") & valid_account_name("glued_name")).select(
        "report_id", F.col("glued_code").alias("code"), F.col("glued_name").alias("name"), "section", "i")
    no_section = F.lit("").alias("section")
    bare = text.select(
        "report_id", F.explode(F.regexp_extract_all("line", F.lit(ANYWHERE), 1)).alias("code"), F.lit(0).cast("long").alias("i")
    ).select("report_id", "code", F.col("code").alias("name"), no_section, "i").distinct()
    key = ["report_id", "code"]

    def first_named(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(F.min_by("name", F.struct("i", "name")).alias("name"), F.min("i").alias("i")).select(
            *key, "name", no_section, "i")

    inner = first_named(text.select(
        "report_id", F.regexp_extract(line, NAME_THEN_CODE, 2).alias("code"),
        clean_account_name(F.regexp_extract(line, NAME_THEN_CODE, 1)).alias("name"), F.col("line_no").alias("i"),
    ).where((F.col("code") != "") & valid_account_name("name")))
    around = first_named(codes.where("code IS NOT NULL AND glued_code IS NOT NULL AND near IS NOT NULL").select(
        *key, F.col("near").alias("name"), "i"))
    named = from_code.unionByName(from_glued)
    have = named.where("name <> code").select(key)
    inner = inner.join(have, key, "left_anti")
    around = around.join(have, key, "left_anti").join(inner.select(key), key, "left_anti")
    return best_names(named.unionByName(inner).unionByName(around).unionByName(bare), known)


def best_names(candidates: DataFrame, known: list[tuple[str, str]] = ()) -> DataFrame:
    """One row per report and code: a known name, else the longest, ties to the earlier line."""
    name = F.col("name")
    for code, fixed in known:
        name = F.when(F.col("code") == code, F.lit(fixed)).otherwise(name)
    rank = F.when(F.col("name") == F.col("code"), 0).otherwise(F.length("name"))
    best = F.min_by(F.struct("name", "section"), F.struct((-rank).alias("r"), F.col("i"), F.col("name").alias("n")))
    return (
        candidates.withColumn("name", name).groupBy("report_id", "code").agg(best.alias("_b"))
        .select("report_id", "code", F.col("_b.name").alias("name"), account_type("code", "_b.name", "_b.section").alias("type"))
    )


def enrich_names(accounts: DataFrame, balance_lines: DataFrame, seq: str | None = None) -> DataFrame:
    """Longer names from a balance report whose lines end in ``DB`` or ``CR``.

    Two names go together when one holds the first twelve letters of the other.
    Either way the shared piece is a 12-gram (or the whole name when shorter,
    from eight letters), so the pairs come from an equi-join on that piece.
    ``seq`` names a column of both sides: an account takes names only from lines with a
    larger one. Without it all lines count.
    """
    from tallyweave.operators.names import holds_prefix

    p = r"(?i)^(.+?)\s+([\d.,]+)\s*(DB|CR)\s*$"
    name = clean_account_name(F.regexp_extract(F.trim("line"), p, 1))
    own, later = (F.lit(0), F.lit(1)) if seq is None else (F.col(seq), F.col(seq))
    found = (
        balance_lines.where(F.trim("line").rlike(p) & ~F.trim("line").rlike(GLUED_LINE)).select(name.alias("other"), later.alias("_later"))
        .where(valid_account_name("other") & (F.length("other") >= 6) & ~F.col("other").rlike("(?i)^(ATIVO|PASSIVO|TOTAL|P A T R)"))
        .groupBy("other").agg(F.max("_later").alias("_later"))
    )
    found = cut(found, "balance-names")
    numbered = accounts.withColumn("_own", own)
    pairs = cut(holds_prefix(accounts.select("name").distinct(), "name", found.select("other"), "other", 12, 8), "name-pairs")
    longest = (
        numbered.select("name", "_own").distinct().join(pairs, "name").join(found, "other").where("_later > _own")
        .groupBy("name", "_own").agg(F.min_by("other", F.struct((-F.length("other")).alias("l"), F.col("other").alias("o"))).alias("_longer"))
    )
    out = numbered.join(longest, ["name", "_own"], "left")
    better = F.col("_longer").isNotNull() & (F.length("_longer") > F.length("name"))
    return out.withColumn("name", F.when(better, F.col("_longer")).otherwise(F.col("name"))).select(*accounts.columns)


def merge_reports(report_lines: DataFrame, reports: DataFrame, known: list[tuple[str, str]] = ()) -> DataFrame:
    """One chart ``(code, name, type)`` from the reports named in ``reports(report_id, seq)``, in the order of ``seq``.

    A report that carries the title of a balance sheet only lengthens names: those of the
    accounts that stand when its turn comes. Any other is a trial balance and replaces the
    accounts of an earlier one code by code. ``known`` accounts that no report has are
    added; the account for what is not classified comes last and is always the fixed one.
    Of reports with one ``seq`` the larger ``report_id`` counts as the later. No lines, or
    no trial balance among them, give the known accounts and the fixed one.
    """
    of = report_lines.join(reports.select("report_id", "seq"), "report_id")
    sheets = of.where(F.col("line").rlike(SHEET_TITLE)).select("report_id", F.lit(True).alias("_sheet")).distinct()
    of = cut(of.join(sheets, "report_id", "left"), "report-lines")
    trial = of.where("_sheet IS NULL").drop("_sheet")
    named = extract_accounts(trial, known).join(reports.select("report_id", "seq"), "report_id")
    last = F.max_by(F.struct("name", "type", "seq"), F.struct("seq", "report_id"))
    standing = cut(named.groupBy("code").agg(last.alias("_l")).select("code", "_l.*"), "accounts")
    chart = enrich_names(standing, of.where("_sheet"), "seq").drop("seq")
    spark = report_lines.sparkSession
    fixed = spark.createDataFrame([(c, n) for c, n in known], "code string, name string")
    fixed = fixed.withColumn("type", account_type("code", "name", F.lit(""))).join(chart.select("code"), "code", "left_anti")
    rest = spark.createDataFrame([UNCLASSIFIED_ACCOUNT], CHART_OF_ACCOUNTS)
    return chart.unionByName(fixed).where(F.col("code") != UNCLASSIFIED_ACCOUNT[0]).unionByName(rest)
