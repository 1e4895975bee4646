"""Named queries over the driver's tables, each with its SQL twin where SQL can say it.

Every query runs on whole tables. ``QUERIES[name](spark, sf_dir)`` gives a
DataFrame; ``ORACLES[name]`` is the DuckDB text for the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyweave import sample
from tallyweave.functions import accounts as acc, dates, filenames as fn, money, text
from tallyweave.operators import classify, links, overlay, quality, reconcile
from tallyweave.plans import export, monthly, publish, reports
from tallyweave.sample import RULE_ROWS, with_clause
from tallyweave.session import work_dir
from tallyweave.sources import accounts, documents, invoices, statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MONEY = ("amount", "debit", "credit", "inflow", "outflow", "total", "total_value", "diff", "bank_amount", "expected_sales")


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query. ``sql`` is prefixed with the definitions of ``views``."""

    def deco(fn_: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_double(fn_(spark, lambda v: sample.view(spark, sf_dir, v), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            prefix = with_clause(*views) if views else ""
            if sql.lstrip().startswith("RECURSIVE,"):
                prefix = prefix.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n"
                sql_ = sql.lstrip()[len("RECURSIVE,"):]
            elif sql.lstrip().startswith(","):
                prefix, sql_ = prefix.rstrip(), sql
            else:
                sql_ = sql
            ORACLES[name] = prefix + sql_
        return fn_

    return deco


def as_double(df: DataFrame) -> DataFrame:
    """Decimals leave the engine as doubles."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def scratch(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


# --- scalars ------------------------------------------------------------------

@query("scalar_normalize", "SELECT doc_id, length(n) AS n_chars_kept, md5(n) AS digest FROM (SELECT doc_id, "
       "regexp_replace(strip_accents(upper(replace(coalesce(text, ''), 'ß', 'SS'))), '[^A-Z0-9]', '', 'g') AS n FROM documents) z")
def _(spark, view, sf):
    n = text.normalize_name("text")
    return sample.table(spark, sf, "documents").select("doc_id", n.alias("n")).select(
        "doc_id", F.length("n").alias("n_chars_kept"), F.md5("n").alias("digest"))


@query("scalar_money", f"""SELECT tx_id, {d('amount')} AS amount, CAST(round(abs(amount) * 100) AS BIGINT) AS cents, {d('amount')} AS from_text, {d('amount')} AS from_reais,
 {d('floor(amount * 100)')} AS dotted, lpad(regexp_replace(coalesce(counterparty_doc, ''), '[^0-9]', '', 'g'), 14, '0') AS padded FROM tx""", ("tx",))
def _(spark, view, sf):
    shown = money.format_brl("amount")
    plain = F.format_string("%.2f", F.floor(F.col("amount") * 100).cast("double") / 100)
    return view("tx").select(
        "tx_id", "amount", money.cents("amount").alias("cents"), money.parse_money(shown).alias("from_text"),
        money.parse_reais(F.concat(F.lit("R$ "), shown)).alias("from_reais"), money.parse_money(plain).alias("dotted"),
        F.coalesce(money.tax_id("counterparty_doc"), F.lit("0" * 14)).alias("padded"),
    )


@query("scalar_dates", """SELECT tx_id, tx_date AS parsed, tx_date AS dotted, NULL::DATE AS invalid, strftime(tx_date, '%Y-%m') AS month, strftime(tx_date, '%m-%Y') AS folder,
 strftime(tx_date, '%d/%m/%Y') AS shown,
 CASE WHEN description LIKE 'POSTO%' OR description LIKE 'Pix - Recebido 01/06%' THEN CAST(regexp_extract(description, '([0-9][0-9])[:\\s]([0-9][0-9])', 1) AS INT) * 60 + CAST(regexp_extract(description, '([0-9][0-9])[:\\s]([0-9][0-9])', 2) AS INT) END AS minute
 FROM tx""", ("tx",))
def _(spark, view, sf):
    shown = dates.format_br_date("tx_date")
    return view("tx").select(
        "tx_id", dates.parse_br_date(F.concat(F.lit("em "), shown)).alias("parsed"),
        dates.parse_br_date(F.concat(F.translate(shown, "/", "."), F.lit(" x"))).alias("dotted"),
        dates.parse_br_date(F.concat(F.lit("31/02/"), F.right(shown, F.lit(4)))).alias("invalid"),
        dates.month_of("tx_date").alias("month"), dates.month_folder(dates.month_of("tx_date")).alias("folder"),
        shown.alias("shown"), dates.minutes_in_text("description").alias("minute"),
    )


OWN = [r"BDF\w* LTDA"]
PARTNERS = [(r"KGF\w*", "PARTNER ONE"), (r"LRG\w*", "PARTNER TWO")]
_HAY = "concat(coalesce(description, ''), ' ', coalesce(counterparty, ''))"
_OWN_SQL = f"regexp_matches({_HAY}, 'BDF[0-9A-Za-z_]* LTDA', 'i')"


@query("counterparty_flags", f"""SELECT tx_id, {_OWN_SQL} AS own_company, CASE WHEN regexp_matches({_HAY}, 'KGF', 'i') THEN 'PARTNER ONE' WHEN regexp_matches({_HAY}, 'LRG', 'i') THEN 'PARTNER TWO' END AS partner FROM tx""", ("tx",))
def _(spark, view, sf):
    hay = classify.haystack()
    return view("tx").select("tx_id", text.matches_any(hay, OWN).alias("own_company"), text.partner_lookup(hay, PARTNERS).alias("partner"))


@query("scalar_names", f"""SELECT tx_id,
 CASE WHEN {_OWN_SQL} OR regexp_matches({_HAY}, 'KGF|LRG', 'i') THEN NULL
  WHEN description LIKE 'Pix - Recebido 01/06%' THEN trim(concat(substr(description, 42), ' ', coalesce(counterparty, '')))
  WHEN description LIKE 'Pix - Recebido%' THEN trim(concat(substr(description, 16), ' ', coalesce(counterparty, '')))
  WHEN description LIKE 'PIX RECEBIDO 2024%' THEN counterparty
  WHEN description LIKE '%Cp :%' THEN trim(concat(regexp_extract(description, 'Cp :[0-9]+-(.+)$', 1), ' ', coalesce(counterparty, '')))
  ELSE counterparty END AS client,
 CASE WHEN counterparty IS NOT NULL THEN counterparty WHEN description LIKE '%Cp :%' THEN regexp_extract(description, 'Cp :[0-9]+-(.+)$', 1) END AS supplier,
 CASE WHEN counterparty IS NOT NULL THEN counterparty ELSE regexp_replace(description, '.*POSTO', 'POSTO') END AS station,
 left(regexp_replace(concat(CAST(tx_id AS STRING), '-sup-', description), '[^a-zA-Z0-9]', '', 'g'), 40) AS attach_key FROM tx""", ("tx",))
def _(spark, view, sf):
    hay = classify.haystack()
    own, partner = text.matches_any(hay, OWN), text.matches_any(hay, [p for p, _ in PARTNERS])
    return view("tx").select(
        "tx_id", text.client_name("description", "counterparty", own, partner).alias("client"),
        text.supplier_name("description", "counterparty").alias("supplier"),
        text.station_name("description", "counterparty").alias("station"),
        text.attachment_key(F.col("tx_id").cast("string"), F.lit("sup"), "description").alias("attach_key"),
    )


_SLIP = r"([0-9]+)\s*-\s*([0-9]{2})([0-9]{2})([0-9]{4})\s*-\s*([^-]+)\s*-\s*([0-9.,]+)"
_SLIP_DATE = "TRY_CAST(concat(regexp_extract(file_name, '{p}', 4), '-', regexp_extract(file_name, '{p}', 3), '-', regexp_extract(file_name, '{p}', 2)) AS DATE)".replace("{p}", _SLIP)


@query("filename_parse", f"""SELECT file_id, CASE WHEN m <> '' THEN {_SLIP_DATE} END AS slip_date, CASE WHEN m <> '' THEN trim(regexp_extract(file_name, '{_SLIP}', 5)) END AS slip_type,
 CASE WHEN m <> '' THEN CAST(replace(replace(regexp_extract(file_name, '{_SLIP}', 6), '.', ''), ',', '.') AS DOUBLE) END AS slip_amount,
 CASE WHEN m <> '' THEN contains(lower(regexp_extract(file_name, '{_SLIP}', 5)), 'pagamento') END AS is_payment,
 TRY_CAST(regexp_extract(file_name, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS DATE) AS iso_date,
 nullif(regexp_extract(file_name, '_([^_]+)\\.pdf$', 1), '') AS payee, nullif(regexp_extract(path, '([0-9]{{44}})', 1), '') AS invoice_key
 FROM (SELECT *, regexp_extract(file_name, '{_SLIP}') AS m FROM files) z""", ("files",))
def _(spark, view, sf):
    slip, transfer = fn.slip_meta("file_name"), fn.transfer_meta("file_name")
    return view("files").select(
        "file_id", slip["date"].alias("slip_date"), slip["type"].alias("slip_type"), slip["amount"].alias("slip_amount"),
        slip["is_payment"].alias("is_payment"), transfer["date"].alias("iso_date"), transfer["counterparty"].alias("payee"),
        fn.invoice_key("path").alias("invoice_key"))


@query("scalar_hashes", "SELECT doc_id, sha1(file_name) AS content, sha1(concat(file_name, CAST(modified AS VARCHAR))) AS id, left(sha1(concat(file_name, CAST(modified AS VARCHAR))), 16) AS short_id FROM fuel_docs", ("fuel_docs",))
def _(spark, view, sf):
    id_ = fn.path_id("file_name", "modified")
    return view("fuel_docs").select("doc_id", fn.content_id("file_name").alias("content"), id_.alias("id"), F.left(id_, F.lit(16)).alias("short_id"))


# --- sources ------------------------------------------------------------------

def _brl(x: Column) -> Column:
    return money.format_brl(x)


def _t(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _line1(sep: str) -> Column:
    return F.concat_ws(sep, dates.format_br_date("tx_date"), F.col("description"), _t("counterparty"), _t("counterparty_doc"),
                       F.concat(F.lit('"'), _brl(F.col("amount")), F.lit('"')), F.lit("0"))


def _line2() -> Column:
    return F.concat_ws(";", F.lit("1"), F.lit("2"), F.lit(""), dates.format_br_date("tx_date"), F.lit(""), F.lit(""), F.lit(""),
                       F.col("tx_id").cast("string"), F.lit(""), F.col("description"), _brl(F.abs("amount")),
                       F.when(F.col("amount") < 0, "D").otherwise("C"), _t("counterparty"))


def _line3() -> Column:
    return F.concat_ws(";", dates.format_br_date("tx_date"), F.concat(F.lit('"'), F.col("description"), F.lit('"')), _brl(F.col("amount")), F.lit("0"))


_TX_OUT = ["tx_id", "tx_date", "description", "counterparty", "counterparty_doc", "amount", "external_ref"]


def _parsed(lines: DataFrame, layout: str) -> DataFrame:
    return statements.parse_lines(lines, F.lit(layout)).where("reason IS NULL").select(*_TX_OUT)


@query("ingest_layout1", f"SELECT tx_id, tx_date, description, counterparty, counterparty_doc, {d('amount')} AS amount, NULL::VARCHAR AS external_ref FROM tx", ("tx",))
def _(spark, view, sf):
    return _parsed(view("tx").select("tx_id", _line1(",").alias("value")), "layout1")


@query("ingest_layout2", f"SELECT tx_id, tx_date, trim(concat(description, ' ', coalesce(counterparty, ''))) AS description, counterparty, NULL::VARCHAR AS counterparty_doc, {d('amount')} AS amount, CAST(tx_id AS VARCHAR) AS external_ref FROM tx", ("tx",))
def _(spark, view, sf):
    return _parsed(view("tx").select("tx_id", _line2().alias("value")), "layout2")


@query("ingest_layout3", f"SELECT tx_id, tx_date, description, nullif(regexp_extract(description, '-([A-Z].+)$', 1), '') AS counterparty, NULL::VARCHAR AS counterparty_doc, {d('amount')} AS amount, NULL::VARCHAR AS external_ref FROM tx", ("tx",))
def _(spark, view, sf):
    return _parsed(view("tx").select("tx_id", _line3().alias("value")), "layout3")


@query("ingest_sheet", ORACLES["ingest_layout1"])
def _(spark, view, sf):
    cells = view("tx").select("tx_id", dates.format_br_date("tx_date").alias("c0"), F.col("description").alias("c1"),
                              F.col("counterparty").alias("c2"), F.col("counterparty_doc").alias("c3"), _brl(F.col("amount")).alias("c4"))
    return statements.parse_sheet(cells).where("reason IS NULL").select(*_TX_OUT)


PREFIXES = {"acct-0": "layout3", "acct-1": "layout1", "acct-2": "layout2"}


def _statement_lines(tx: DataFrame) -> DataFrame:
    """Lines in the layout of their account; accounts without a layout get layout 3 lines.

    Spark writes ``.txt`` files, so layout 1 lines use the text separator.
    """
    layout = statements.layout_of("bank_account_id", F.lit("x.txt"), PREFIXES)
    line = F.when(layout == "layout1_txt", _line1(";")).when(layout == "layout2", _line2()).otherwise(_line3())
    return tx.select(F.col("bank_account_id").alias("account"), dates.month_of("tx_date").alias("m"), line.alias("value"))


_UNION_SQL = f"""SELECT bank_account_id, CASE WHEN bank_account_id LIKE 'acct-0%' OR bank_account_id LIKE 'acct-1%' OR bank_account_id LIKE 'acct-2%' THEN 'accepted' ELSE 'no_layout' END AS outcome,
 count(*) AS n, {d('sum(CASE WHEN bank_account_id LIKE ' + repr('acct-0%') + ' OR bank_account_id LIKE ' + repr('acct-1%') + ' OR bank_account_id LIKE ' + repr('acct-2%') + ' THEN amount END)')} AS total FROM tx GROUP BY 1, 2"""


@query("ingest_union", _UNION_SQL, ("tx",))
def _(spark, view, sf):
    path = scratch(spark, "statements")
    _statement_lines(view("tx")).select("account", "value").write.partitionBy("account").text(path)
    lines = statements.read_lines(spark, path).withColumn("bank_account_id", F.regexp_extract("path", "account=([^/]+)/", 1))
    parsed = statements.parse_statements(lines, PREFIXES)
    return parsed.groupBy("bank_account_id", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("stream_ingest", f"""SELECT month, category, count(*) AS n, count(*) AS joined, {d('sum(amount)')} AS total FROM ledger
 WHERE bank_account_id LIKE 'acct-0%' OR bank_account_id LIKE 'acct-1%' OR bank_account_id LIKE 'acct-2%' GROUP BY 1, 2""", ("ledger",))
def _(spark, view, sf):
    from tallyweave.streaming import landing

    base = scratch(spark, "landing")
    _statement_lines(view("tx")).select("account", "value").write.partitionBy("account").text(f"{base}/in")
    landing.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", PREFIXES, view("bank_accounts"), RULE_ROWS, max_files=12).awaitTermination()
    ledger = spark.read.parquet(f"{base}/out/ledger")
    # Several batches: an id that stood twice would multiply the rows of this join.
    again = ledger.join(ledger.select("entry_id", F.col("batch").alias("_b")), "entry_id")
    counted = again.groupBy("month", "category").agg(F.count("*").alias("joined"))
    return ledger.groupBy("month", "category").agg(F.count("*").alias("n"), F.sum("amount").alias("total")).join(counted, ["month", "category"])


@query("ingest_copies", f"""SELECT a AS bank_account_id, count(*) AS n, count(*) AS ids, {d('sum(amount)')} AS total FROM tx, (VALUES ('acct-0x'), ('acct-0y')) v(a) GROUP BY a""", ("tx",))
def _(spark, view, sf):
    """Two accounts share their files' content and each has a copy: copies go, the other account's rows stay."""
    base = scratch(spark, "copies")
    lines = view("tx").select(_line3().alias("value"))
    for account in ("acct-0x", "acct-0y"):
        for copy in ("a", "b"):
            lines.write.text(f"{base}/account={account}/copy={copy}")
    read = statements.numbered(statements.read_lines(spark, base).withColumn("bank_account_id", F.regexp_extract("path", "account=([^/]+)/", 1)))
    kept = statements.first_copies(statements.file_fingerprints(read))
    fresh = statements.with_line_ids(read.join(kept.select("path"), "path", "left_semi"))
    return statements.accepted(statements.parse_statements(fresh, PREFIXES)).groupBy("bank_account_id").agg(
        F.count("*").alias("n"), F.count_distinct("tx_id").alias("ids"), F.sum("amount").alias("total"))


_OWN_ID = "99999999000199"


def _invoice_xml(fiscal: DataFrame) -> DataFrame:
    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    own = F.lit(f"<CNPJ>{_OWN_ID}</CNPJ><xNome>OWN</xNome>")
    name = F.coalesce(tag("xNome", F.col("counterparty_name")), F.lit(""))
    other = F.concat(tag("CNPJ", F.col("counterparty_doc")), name)
    inbound = F.col("fiscal_id") % 2 == 1
    item = tag("det", tag("prod", F.coalesce(tag("CFOP", F.col("cfop")), F.lit("<x>1</x>"))))
    items = F.when(F.col("fiscal_id") % 3 == 0, F.concat(item, F.lit("<det><prod><CFOP>0000</CFOP></prod></det>"))).otherwise(item)
    info = tag("infNFe", F.concat(
        tag("ide", F.concat(tag("nNF", F.concat(F.lit("00"), F.col("doc_number"))), tag("mod", F.col("doc_model")),
                            tag("dhEmi", F.concat(F.col("issue_date").cast("string"), F.lit("T10:00:00-03:00"))))),
        tag("emit", F.when(inbound, other).otherwise(own)), tag("dest", F.when(inbound, own).otherwise(other)), items,
        tag("total", tag("ICMSTot", F.concat(tag("vNF", F.col("total_value").cast("string")), F.lit("<vICMS>0.00</vICMS>")))),
    ))
    nfe = tag("NFe", info)
    whole = F.when(F.col("fiscal_id") % 5 == 0, nfe).otherwise(tag("nfeProc", nfe))
    return fiscal.select("fiscal_id", whole.alias("xml"))


@query("invoice_xml", f"""SELECT fiscal_id, doc_number, doc_model, cfop, issue_date, counterparty_name, counterparty_doc,
 CASE WHEN fiscal_id % 2 = 1 THEN 'entrada' ELSE 'saida' END AS direction, {d('total_value')} AS total_value, CAST(NULL AS DOUBLE) AS icms_value FROM fiscal""", ("fiscal",))
def _(spark, view, sf):
    return invoices.parse_invoices(_invoice_xml(view("fiscal")), _OWN_ID).select(
        "fiscal_id", "doc_number", "doc_model", "cfop", "issue_date", "counterparty_name", "counterparty_doc", "direction", "total_value", "icms_value")


_SPOILT = "CASE WHEN fiscal_id % 11 = 0 THEN 'damaged' WHEN fiscal_id % 23 = 0 THEN 'no_invoice' ELSE 'accepted' END"


@query("invoice_files", f"""SELECT month, outcome, count(*) AS n, {d("sum(CASE WHEN outcome = 'accepted' THEN total_value END)")} AS total, count(DISTINCT CASE WHEN outcome = 'accepted' THEN doc_number END) AS numbers
 FROM (SELECT strftime(issue_date, '%Y-%m') AS month, total_value, doc_number, {_SPOILT} AS outcome FROM fiscal) z GROUP BY 1, 2""", ("fiscal",))
def _(spark, view, sf):
    """Bundles by month written and read back; documents with a broken tag or another root go to quarantine."""
    path = scratch(spark, "invoice-bundles")
    made = _invoice_xml(view("fiscal")).join(view("fiscal").select("fiscal_id", dates.month_of("issue_date").alias("month")), "fiscal_id")
    outcome = F.expr(_SPOILT)
    xml = F.when(outcome == "damaged", F.regexp_replace("xml", "</emit>", "</emix>")).when(
        outcome == "no_invoice", F.concat(F.lit("<evento>"), F.col("fiscal_id").cast("string"), F.lit("</evento>"))).otherwise(F.col("xml"))
    made.select("month", xml.alias("value")).write.partitionBy("month").text(path)
    files = invoices.read_invoice_bundles(spark, path).withColumn("month", F.regexp_extract("path", "month=([0-9-]+)/", 1))
    good = invoices.parse_invoices(files, _OWN_ID).select("month", F.lit("accepted").alias("outcome"), "total_value", "doc_number")
    bad = invoices.quarantined_invoices(files).select("month", F.col("reason").alias("outcome"))
    return good.unionByName(bad, allowMissingColumns=True).groupBy("month", "outcome").agg(
        F.count("*").alias("n"), F.sum("total_value").alias("total"), F.count_distinct("doc_number").alias("numbers"))


@query("invoice_sheet", f"""SELECT doc_number, doc_model, cfop, issue_date, counterparty_name, NULL::VARCHAR AS counterparty_doc, {d('total_value')} AS total_value, cancelled FROM fiscal""", ("fiscal",))
def _(spark, view, sf):
    c = invoices.SHEET_COLUMNS
    reais = F.concat(F.lit("R$ "), _brl(F.col("total_value")))
    sheet = view("fiscal").select(
        F.col("doc_number").alias(c["doc_number"]), F.col("doc_model").alias(c["doc_model"]), F.col("cfop").alias(c["cfop"]),
        dates.format_br_date("issue_date").alias(c["issue_date"]), F.col("counterparty_name").alias(c["counterparty_name"]),
        reais.alias(c["total_value"]), F.lit("").alias(c["icms_value"]), F.lit("").alias(c["pis_value"]), F.lit("").alias(c["cofins_value"]),
        F.when(F.col("cancelled"), "S").alias(c["cancelled"]))
    return invoices.invoices_from_sheet(sheet).drop("icms_value", "pis_value", "cofins_value")


@query("tax_guide_extract", """SELECT doc_id, CAST(n_chars AS DOUBLE) AS amount, DATE '2024-02-20' AS due_date, md5(left(concat('Guia: Valor a recolher em reais: ', CAST(n_chars AS VARCHAR), ',00; Vencimento: 20/02/2024 ', text), 500)) AS excerpt_digest FROM documents""")
def _(spark, view, sf):
    body = F.concat(F.lit("Guia: Valor a recolher em reais: "), F.col("n_chars").cast("string"), F.lit(",00; Vencimento: 20/02/2024 "), F.col("text"))
    return sample.table(spark, sf, "documents").select("doc_id", documents.tax_guide(body).alias("g")).select(
        "doc_id", "g.amount", "g.due_date", F.md5("g.excerpt").alias("excerpt_digest"))


BANK_FOLDERS = [("COMPROVANTES", "bank-a", "1.01.01.01.02.0001"), ("XML", "bank-b", "1.01.01.01.02.0002"), ("NOTAS.*BDF", "bank-c", "1.01.01.01.03.0001")]
_KIND_SQL = """CASE WHEN path LIKE '%XML 06-2024%' THEN 'danfe' WHEN path LIKE '%COMPROVANTES%' THEN 'comprovante' WHEN path LIKE '%NOTAS FISCAL%' THEN 'nota_fiscal' ELSE 'anexo' END"""


@query("file_inventory", f"""SELECT file_id, file_name AS name, '.pdf' AS ext, {_KIND_SQL} AS kind,
 CASE WHEN path LIKE '%COMPROVANTES%' THEN 'bank-a' WHEN path LIKE '%XML%' THEN 'bank-b' WHEN path LIKE '%NOTAS%BDF%' THEN 'bank-c' END AS bank_account_id,
 CASE WHEN path LIKE '%COMPROVANTES%' THEN coalesce(CASE WHEN m <> '' THEN {_SLIP_DATE} END, TRY_CAST(regexp_extract(file_name, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS DATE)) END AS meta_date,
 CASE WHEN path LIKE '%COMPROVANTES%' AND m = '' THEN nullif(regexp_extract(file_name, '_([^_]+)\\.pdf$', 1), '') END AS meta_counterparty
 FROM (SELECT *, regexp_extract(file_name, '{_SLIP}') AS m FROM files) z""", ("files",))
def _(spark, view, sf):
    return documents.inventory(view("files").drop("bank_account_id"), BANK_FOLDERS).select(
        "file_id", "name", "ext", "kind", "bank_account_id", "meta_date", "meta_counterparty")


@query("file_listing", f"""SELECT substr(path, 7, 7) AS mm, {_KIND_SQL.replace("'danfe'", "'xml_nfe'")} AS kind, CASE WHEN path LIKE '%COMPROVANTES%' THEN 'bank-a' WHEN path LIKE '%XML%' THEN 'bank-b' END AS bank_account_id,
 CAST(sum(strlen(file_name) + 1) AS BIGINT) AS bytes FROM files GROUP BY 1, 2, 3""", ("files",))
def _(spark, view, sf):
    """Files written below month and kind folders, listed without being opened; their sizes add up to what was written."""
    path = scratch(spark, "share")
    folder = F.regexp_extract("path", "^share/[^/]+/([^/]+)/", 1)
    view("files").select(F.substring("path", 7, 7).alias("mm"), folder.alias("folder"), F.col("file_name").alias("value")).write.partitionBy("mm", "folder").text(path)
    listed = documents.list_files(spark, path).withColumn("mm", F.regexp_extract("path", "mm=([0-9-]+)/", 1)).withColumn("path", F.regexp_extract("path", "(mm=.*)$", 1))
    return documents.inventory(listed, BANK_FOLDERS).groupBy("mm", "kind", "bank_account_id").agg(F.sum("size").alias("bytes"))


@query("file_kind", """SELECT page_id, regexp_extract(base, '[^.]+.*(\\.[^.]*)$', 1) AS ext, CASE WHEN contains(u, 'XML') THEN 'xml_nfe' WHEN contains(u, 'COMBUST') THEN 'combustivel' WHEN contains(u, 'BOLETO') THEN 'boleto'
 WHEN regexp_extract(base, '[^.]+.*(\\.[^.]*)$', 1) IN ('.pdf', '.jpg', '.jpeg', '.tiff', '.tif', '.txt', '.xml') THEN 'anexo' ELSE 'outro' END AS kind
 FROM (SELECT page_id, upper(url) AS u, lower(regexp_extract(url, '([^/]*)$', 1)) AS base FROM pages) z""")
def _(spark, view, sf):
    return sample.table(spark, sf, "pages").select("page_id", fn.extension("url").alias("ext"), fn.file_kind("url").alias("kind"))


@query("files_by_kind", f"SELECT kind, count(*) AS n FROM (SELECT {_KIND_SQL} AS kind FROM files) z GROUP BY ROLLUP (kind)", ("files",))
def _(spark, view, sf):
    return documents.files_by_kind(view("files").select(fn.file_kind("path").alias("kind")))


@query("path_to_bank", """SELECT file_id, CASE WHEN path LIKE '%COMPROVANTES%' THEN 'bank-a' WHEN path LIKE '%XML%' THEN 'bank-b' WHEN path LIKE '%NOTAS%BDF%' THEN 'bank-c' END AS bank_account_id,
 CASE WHEN path LIKE '%COMPROVANTES%' THEN '1.01.01.01.02.0001' WHEN path LIKE '%XML%' THEN '1.01.01.01.02.0002' WHEN path LIKE '%NOTAS%BDF%' THEN '1.01.01.01.03.0001' END AS coa_code FROM files""", ("files",))
def _(spark, view, sf):
    return fn.with_bank_by_path(view("files").select("file_id", "path"), BANK_FOLDERS).drop("path")


@query("fuel_docs", """SELECT doc_id, modified AS doc_date, CASE WHEN file_name LIKE 'Scan%' THEN concat(substr(file_name, 15, 2), ':', substr(file_name, 17, 2)) WHEN file_name LIKE 'Digi%' THEN concat(substr(file_name, 23, 2), ':', substr(file_name, 25, 2)) END AS doc_time,
 CASE WHEN file_name LIKE 'Scan%' THEN '.jpg' ELSE '.pdf' END AS ext FROM fuel_docs""", ("fuel_docs",))
def _(spark, view, sf):
    return documents.fuel_receipts(view("fuel_docs")).select("doc_id", "doc_date", "doc_time", "ext")


@query("dedupe_files", "SELECT md5(text) AS hash, min(concat('doc/', lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS path FROM documents GROUP BY 1")
def _(spark, view, sf):
    files = sample.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.md5("text").alias("hash"))
    return statements.first_copies(files).select("hash", "path")


@query("duplicate_files", "SELECT md5(text) AS hash, count(*) AS copies, min(concat('doc/', lpad(CAST(doc_id AS VARCHAR), 12, '0'))) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, view, sf):
    files = sample.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.md5("text").alias("hash"))
    return statements.duplicate_hashes(files)


@query("coa_extract", f"""SELECT p_brand AS report_id, {sample._CODE} AS code, min_by(p_name2, (-length(p_name2), p_name2)) AS name, 'despesa' AS type
 FROM (SELECT *, CASE p_partkey % 3 WHEN 2 THEN concat(p_name, ' ', p_type) ELSE p_name END AS p_name2 FROM part) z GROUP BY 1, 2""")
def _(spark, view, sf):
    return accounts.extract_accounts(view("report_lines"))


_LETTERS = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
_KNOWN = [("4.01.01.00.02.0001", "Known"), ("3.01.01.01", "Known and in no report")]
_OTHER, _NAME = _LETTERS.format("o.other"), _LETTERS.format("a.name")


@query("coa_merge", f""", part2 AS (SELECT *, {sample._CODE} AS code FROM part),
 standing AS (SELECT code, CASE WHEN code = '{_KNOWN[0][0]}' THEN '{_KNOWN[0][1]}' WHEN p_partkey % 2 = 0 THEN concat(p_name, ' revisto') WHEN p_partkey % 3 = 2 THEN concat(p_name, ' ', p_type) ELSE p_name END AS name,
  CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END AS seq FROM part2),
 others AS (SELECT DISTINCT concat('Grupo ', p_name) AS other, 2 AS seq FROM part UNION SELECT DISTINCT concat(p_type, ' ', p_name, ' consolidado'), 4 FROM part WHERE p_partkey % 7 = 0),
 names AS (SELECT DISTINCT name, seq FROM standing),
 longer AS (SELECT a.name, a.seq, min_by(o.other, (-length(o.other), o.other)) AS other FROM names a JOIN others o ON o.seq > a.seq
  AND length({_NAME}) >= 8 AND length({_OTHER}) >= 8 AND (contains({_OTHER}, left({_NAME}, 12)) OR contains({_NAME}, left({_OTHER}, 12))) GROUP BY 1, 2)
 SELECT s.code, CASE WHEN length(l.other) > length(s.name) THEN l.other ELSE s.name END AS name, 'despesa' AS type FROM standing s LEFT JOIN longer l ON l.name = s.name AND l.seq = s.seq
 UNION ALL SELECT '{_KNOWN[1][0]}', '{_KNOWN[1][1]}', 'receita' UNION ALL SELECT '9.9.9.99', 'Conta a classificar (revisão manual)', 'despesa'""".replace(", part2", "WITH part2", 1))
def _(spark, view, sf):
    """Trial balances of all brands, a balance sheet, a revised trial balance, and a second balance sheet."""
    part = sample.table(spark, sf, "part")
    code = F.expr(sample._CODE)
    line = lambda report, text: (F.lit(report).alias("report_id"), F.col("p_partkey").alias("line_no"), F.concat(*text).alias("line"))
    title = part.select(F.explode(F.array(F.lit("sheet-1"), F.lit("sheet-2"))).alias("report_id"), F.lit(-1).cast("long").alias("line_no"), F.lit("Balanço Patrimonial").alias("line")).distinct()
    revised = part.where("p_partkey % 2 = 0").select(*line("revised", [F.col("p_name"), F.lit(" revisto"), code, F.lit("  1.234,56 D")]))
    one = part.select(*line("sheet-1", [F.lit("Grupo "), F.col("p_name"), F.lit("  1.234,56 DB")]))
    two = part.where("p_partkey % 7 = 0").select(*line("sheet-2", [F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit(" consolidado 9,00CR")]))
    base = view("report_lines").select("report_id", "line_no", "line")
    lines = base.unionByName(title).unionByName(revised).unionByName(one).unionByName(two)
    order = {"sheet-1": 2, "revised": 3, "sheet-2": 4}
    seq = F.lit(1)
    for report, place in order.items():
        seq = F.when(F.col("report_id") == report, place).otherwise(seq)
    reports_ = lines.select("report_id").distinct().withColumn("seq", seq)
    return accounts.merge_reports(lines, reports_, _KNOWN)


@query("ledger_json_roundtrip", f"SELECT month, count(*) AS n, {d('sum(amount)')} AS total, CAST(sum(k) AS BIGINT) AS attached FROM (SELECT l.*, coalesce(a.k, 0) AS k FROM ledger l LEFT JOIN (SELECT entry_id, count(*) AS k FROM attachments GROUP BY 1) a ON a.entry_id = l.entry_id) z GROUP BY 1", ("ledger", "attachments"))
def _(spark, view, sf):
    path = scratch(spark, "month-documents")
    nested = export.nest_attachments(view("ledger"), view("attachments"))
    export.write_month_documents(nested, path)
    back = export.read_month_documents(spark, path, nested.schema)
    return back.groupBy("month").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.sum(F.size("attachments")).alias("attached"))


# --- ledger and rules ------------------------------------------------------------

def _rules_case(column: int) -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    hay = "concat(description, ' ', coalesce(counterparty, ''))"
    status = {classify.VERIFY: "manual_review"}
    out = "CASE"
    for _, p, category, account, nature in RULE_ROWS:
        value = [category, account, status.get(nature, "matched")][column]
        out += f" WHEN regexp_matches({hay}, {lit(p)}, 'i') THEN {lit(value)}"
    return out + f" ELSE {lit([classify.UNCLASSIFIED, '9.9.9.99', 'manual_review'][column])} END"


_CLASSIFY_SQL = f"SELECT tx_id, {_rules_case(0)} AS category, {_rules_case(1)} AS counter_account, {_rules_case(2)} AS status FROM tx"


@query("classify_rules", _CLASSIFY_SQL, ("tx",))
def _(spark, view, sf):
    return classify.classify(view("tx"), RULE_ROWS).select("tx_id", "category", "counter_account", "status")


@query("classify_rule_table", _CLASSIFY_SQL, ("tx",))
def _(spark, view, sf):
    return classify.classify_by_table(view("tx"), classify.rules_frame(spark, RULE_ROWS)).select("tx_id", "category", "counter_account", "status")


_LEDGER_COLS = ["entry_id", "tx_id", "entry_date", "month", "description", "counterparty", "bank_account_id", "bank_coa", "category", "status", "amount", "debit_account", "credit_account"]
_LEDGER_SQL = ", ".join(d(c) + " AS amount" if c == "amount" else c for c in _LEDGER_COLS)


@query("ledger_build", f"SELECT {_LEDGER_SQL} FROM ledger", ("ledger",))
def _(spark, view, sf):
    return classify.build_ledger(view("tx"), view("bank_accounts"), RULE_ROWS).drop("signed_amount")


@query("double_entry", f"SELECT debit_account, credit_account, count(*) AS n, {d('sum(amount)')} AS total FROM ledger GROUP BY 1, 2", ("ledger",))
def _(spark, view, sf):
    led = classify.build_ledger(view("tx"), view("bank_accounts"), RULE_ROWS)
    return led.groupBy("debit_account", "credit_account").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("category_counts", "SELECT category, status, count(*) AS n FROM ledger GROUP BY 1, 2", ("ledger",))
def _(spark, view, sf):
    return reports.category_counts(view("ledger"))


@query("raw_payload", "SELECT tx_id, CAST(tx_date AS VARCHAR) AS tx_date, counterparty FROM tx", ("tx",))
def _(spark, view, sf):
    packed = view("tx").select("tx_id", F.to_json(F.struct("tx_date", "description", "counterparty", "amount")).alias("raw_json"))
    return packed.select("tx_id", F.get_json_object("raw_json", "$.tx_date").alias("tx_date"), F.get_json_object("raw_json", "$.counterparty").alias("counterparty"))


# --- views, filters, totals ---------------------------------------------------------

_NAMES = "LEFT JOIN chart_of_accounts cd ON cd.code = l.debit_account LEFT JOIN chart_of_accounts cc ON cc.code = l.credit_account"


@query("ledger_enriched", f"SELECT l.entry_id, l.entry_date, l.debit_account, cd.name AS debit_name, l.credit_account, cc.name AS credit_name, {d('l.amount')} AS amount, t.counterparty_doc FROM ledger l JOIN tx t ON t.tx_id = l.tx_id {_NAMES}", ("ledger", "tx", "chart_of_accounts"))
def _(spark, view, sf):
    return reports.enrich(view("ledger"), view("tx").select("tx_id", "counterparty_doc"), view("chart_of_accounts")).select(
        "entry_id", "entry_date", "debit_account", "debit_name", "credit_account", "credit_name", "amount", "counterparty_doc")


_SUMMARY = f"{d('sum(CASE WHEN l.debit_account = b.coa_code THEN l.amount ELSE 0 END)')} AS inflow, {d('sum(CASE WHEN l.credit_account = b.coa_code THEN l.amount ELSE 0 END)')} AS outflow"


@query("bank_summary", f"SELECT l.bank_account_id, {_SUMMARY}, count(*) AS n, count(*) FILTER (WHERE l.status = 'manual_review') AS pending FROM ledger l JOIN bank_accounts b ON b.bank_account_id = l.bank_account_id GROUP BY 1", ("ledger", "bank_accounts"))
def _(spark, view, sf):
    return reports.bank_summary(view("ledger"), view("bank_accounts"))


@query("t_account", f"SELECT account, {d('sum(debit)')} AS debit, {d('sum(credit)')} AS credit FROM (SELECT debit_account AS account, sum(amount) AS debit, 0 AS credit FROM ledger GROUP BY 1 UNION ALL SELECT credit_account, 0, sum(amount) FROM ledger GROUP BY 1) z GROUP BY 1", ("ledger",))
def _(spark, view, sf):
    return reports.t_account(view("ledger"))


@query("ledger_filter", f"SELECT entry_id, {d('amount')} AS amount FROM ledger WHERE month = '1998-10' AND status = 'manual_review' AND bank_account_id = 'acct-4'", ("ledger",))
def _(spark, view, sf):
    return reports.filter_ledger(view("ledger"), "1998-10", "manual_review", "acct-4").select("entry_id", "amount")


@query("ledger_search", "SELECT entry_id FROM ledger WHERE contains(lower(concat_ws(' ', description, counterparty, category, debit_account, credit_account)), 'posto machinery')", ("ledger",))
def _(spark, view, sf):
    return reports.search_text(view("ledger"), "POSTO Machinery", reports.LEDGER_SEARCH).select("entry_id")


@query("account_search", "SELECT code, name FROM chart_of_accounts WHERE contains(strip_accents(lower(concat(code, ' ', name))), 'nacao') OR (contains(strip_accents(lower(concat(code, ' ', name))), 'cartoes') AND contains(strip_accents(lower(concat(code, ' ', name))), 'receber')) ORDER BY code LIMIT 80", ("chart_of_accounts",))
def _(spark, view, sf):
    return reports.search_accounts(view("chart_of_accounts"), "Cartões receber").select("code", "name")


@query("unclassified", "SELECT entry_id, CASE WHEN debit_account = '9.9.9.99' THEN 'debit' WHEN credit_account = '9.9.9.99' THEN 'credit' END AS side, CASE status WHEN 'matched' THEN 'Conciliado' WHEN 'manual_review' THEN 'Revisar' END AS label FROM ledger WHERE status = 'manual_review' OR debit_account = '9.9.9.99' OR credit_account = '9.9.9.99' OR category ILIKE '%não classificado%'", ("ledger",))
def _(spark, view, sf):
    return view("ledger").where(acc.unclassified()).select("entry_id", acc.pending_side().alias("side"), reports.status_label().alias("label"))


@query("posting_account", "SELECT entry_id, CASE WHEN debit_account <> '9.9.9.99' AND debit_account <> bank_coa THEN debit_account WHEN credit_account <> '9.9.9.99' THEN credit_account END AS posting FROM ledger", ("ledger",))
def _(spark, view, sf):
    return view("ledger").select("entry_id", acc.posting_account().alias("posting"))


_FUEL_SQL = r"(debit_account LIKE '4.02.01.01.06%' OR category ILIKE '%combust%' OR regexp_matches(concat(coalesce(description, ''), ' ', coalesce(counterparty, '')), 'POSTOS?\s|POSTO\s|COMBUST|LUBRIFIC|GASOLINA|DIESEL|ABASTEC', 'i'))"


@query("fuel_entries", f"SELECT entry_id, {d('amount')} AS amount FROM ledger WHERE {_FUEL_SQL}", ("ledger",))
def _(spark, view, sf):
    return view("ledger").where(acc.fuel_entry()).select("entry_id", "amount")


@query("fuel_by_bank", f"SELECT coalesce(bank_account_id, '—') AS bank, {d('sum(amount)')} AS total, count(*) AS n FROM ledger WHERE {_FUEL_SQL} GROUP BY 1", ("ledger",))
def _(spark, view, sf):
    return reports.fuel_by_bank(view("ledger"))


@query("sale_docs", f"SELECT cfop, count(*) AS n, {d('sum(total_value)')} AS total FROM fiscal WHERE NOT cancelled AND coalesce(cfop, '') NOT IN ('5551', '5552', '5922', '5923', '5929', '5949') GROUP BY 1", ("fiscal",))
def _(spark, view, sf):
    return view("fiscal").where(acc.sale_document()).groupBy("cfop").agg(F.count("*").alias("n"), F.sum("total_value").alias("total"))


@query("ledger_attachments", "SELECT l.entry_id, l.category, a.file_name FROM ledger l LEFT JOIN attachments a ON a.entry_id = l.entry_id", ("ledger", "attachments"))
def _(spark, view, sf):
    return reports.ledger_with_attachments(view("ledger").select("entry_id", "category"), view("attachments"))


@query("attachment_list", "SELECT a.entry_id, l.entry_date, a.file_name, a.match_score FROM attachments a JOIN ledger l ON l.entry_id = a.entry_id WHERE l.month = '1998-10'", ("ledger", "attachments"))
def _(spark, view, sf):
    return reports.attachment_list(view("ledger"), view("attachments"), "1998-10").select("entry_id", "entry_date", "file_name", "match_score")


@query("ledger_nested", "SELECT l.entry_id, coalesce(a.n, 0) AS n, coalesce(a.names, '') AS names FROM ledger l LEFT JOIN (SELECT entry_id, count(*) AS n, string_agg(concat(file_name, '|', match_type), '; ' ORDER BY file_name, file_type, match_type, match_score) AS names FROM attachments GROUP BY 1) a ON a.entry_id = l.entry_id", ("ledger", "attachments"))
def _(spark, view, sf):
    nested = export.nest_attachments(view("ledger").select("entry_id"), view("attachments"))
    names = F.array_join(F.transform("attachments", lambda a: F.concat(a["file_name"], F.lit("|"), a["match_type"])), "; ")
    return nested.select("entry_id", F.size("attachments").cast("long").alias("n"), names.alias("names"))


@query("invoice_coverage", "SELECT count(*) AS clients, count(has) AS with_invoice, count(*) - count(has) AS without_invoice FROM (SELECT l.entry_id, a.has FROM ledger l LEFT JOIN (SELECT DISTINCT entry_id, 1 AS has FROM attachments WHERE file_name LIKE '%DANFE%') a ON a.entry_id = l.entry_id WHERE l.category ILIKE '%cliente%') z", ("ledger", "attachments"))
def _(spark, view, sf):
    return reports.invoice_coverage(view("ledger"), view("attachments"))


@query("missing_invoice", "SELECT entry_id FROM ledger WHERE category ILIKE '%cliente%' AND entry_id NOT IN (SELECT entry_id FROM attachments WHERE file_name LIKE '%DANFE%')", ("ledger", "attachments"))
def _(spark, view, sf):
    return reports.missing_invoice(view("ledger"), view("attachments")).select("entry_id")


@query("dashboard_counts", "SELECT count(*) AS entries, count(*) FILTER (WHERE status = 'manual_review') AS pending, count(*) FILTER (WHERE entry_id IN (SELECT entry_id FROM attachments)) AS with_attachments, count(DISTINCT bank_account_id) AS banks FROM ledger", ("ledger", "attachments"))
def _(spark, view, sf):
    return reports.dashboard(view("ledger"), view("attachments"))


@query("top_receipts", f"SELECT entry_id, entry_date, {d('amount')} AS amount FROM ledger WHERE category ILIKE '%cliente%' ORDER BY ledger.amount DESC, entry_id LIMIT 15", ("ledger",))
def _(spark, view, sf):
    return reports.top_receipts(view("ledger")).select("entry_id", "entry_date", "amount")


@query("ledger_sorted", "SELECT row_number() OVER (ORDER BY entry_date, entry_id) AS place, entry_id FROM ledger", ("ledger",))
def _(spark, view, sf):
    from pyspark.sql import Window as W

    ledger = view("ledger")
    day = ledger.groupBy("entry_date").agg(F.count("*").alias("n"))
    before = day.select("entry_date", F.coalesce(F.sum("n").over(W.orderBy("entry_date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    inside = F.row_number().over(W.partitionBy("entry_date").orderBy("entry_id"))
    return ledger.withColumn("r", inside).join(before, "entry_date").select((F.col("b") + F.col("r")).cast("long").alias("place"), "entry_id")


@query("coa_sorted", """SELECT code, name, type, row_number() OVER (ORDER BY list_transform(string_split(code, '.'), lambda x: CAST(x AS INT)), code) AS place
 FROM (SELECT * FROM chart_of_accounts UNION ALL SELECT * FROM incoming_accounts WHERE code NOT IN (SELECT code FROM chart_of_accounts)) z""", ("chart_of_accounts", "incoming_accounts"))
def _(spark, view, sf):
    chart, more = view("chart_of_accounts"), view("incoming_accounts")
    both = chart.unionByName(more.join(chart.select("code"), "code", "left_anti").select(*chart.columns))
    ordered = reports.sorted_chart(both)
    place = F.row_number().over(W.orderBy(acc.code_sort_key("code"), "code"))  # one account chart
    return ordered.withColumn("place", place.cast("long"))


@query("chart_seed", "SELECT code, name, type FROM incoming_accounts", ("incoming_accounts",))
def _(spark, view, sf):
    """The accounts as a seed file, one JSON array, and read back."""
    path = scratch(spark, "chart-seed")
    accounts.write_chart(view("incoming_accounts"), path)
    return accounts.read_chart(spark, path)


@query("coa_counts", "SELECT type, count(*) AS n, count(*) FILTER (WHERE code LIKE '2.01.01.01.01.%') AS suppliers, count(*) FILTER (WHERE name = code) AS unnamed FROM (SELECT * FROM chart_of_accounts UNION ALL SELECT * FROM incoming_accounts) z GROUP BY 1", ("chart_of_accounts", "incoming_accounts"))
def _(spark, view, sf):
    return reports.account_counts(view("chart_of_accounts").unionByName(view("incoming_accounts")))


@query("value_lookup", f"SELECT fiscal_id, {d('total_value')} AS total_value FROM fiscal WHERE abs(total_value - 112946.27) < 0.05", ("fiscal",))
def _(spark, view, sf):
    return reports.value_lookup(view("fiscal"), 112946.27).select("fiscal_id", "total_value")


@query("account_types", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'patrimonio' ELSE CASE p_partkey % 4 WHEN 0 THEN 'ativo' WHEN 1 THEN 'passivo' WHEN 2 THEN 'receita' ELSE 'despesa' END END AS type FROM part")
def _(spark, view, sf):
    code = F.concat((F.col("p_partkey") % 4 + 1).cast("string"), F.lit(".01"))
    name = F.when(F.col("p_partkey") % 5 == 4, F.concat(F.lit("Lucro "), "p_name")).otherwise(F.col("p_name"))
    return sample.table(spark, sf, "part").select("p_partkey", acc.account_type(code, name).alias("type"))


# --- overlays and rebuilds -----------------------------------------------------------

def _latest(f: str) -> str:
    return f"max_by({f}, seq) FILTER (WHERE {f} IS NOT NULL AND {f} <> '') AS n_{f}"


_PATCHED = (
    ", patched AS (SELECT l.* REPLACE (coalesce(o.n_debit_account, l.debit_account) AS debit_account, coalesce(o.n_credit_account, l.credit_account) AS credit_account, "
    "coalesce(o.n_category, l.category) AS category, coalesce(o.n_status, l.status) AS status) FROM ledger l LEFT JOIN (SELECT entry_id, "
    + ", ".join(_latest(f) for f in overlay.FIELDS) + " FROM overrides GROUP BY 1) o ON o.entry_id = l.entry_id)\n"
)


@query("patch_coalesce", _PATCHED + "SELECT entry_id, debit_account, credit_account, category, status FROM patched", ("ledger", "overrides"))
def _(spark, view, sf):
    return overlay.apply_changes(view("ledger"), view("overrides")).select("entry_id", "debit_account", "credit_account", "category", "status")


@query("override_overlay", _PATCHED + f"SELECT l.entry_id, l.status, l.category, cd.name AS debit_name, cc.name AS credit_name FROM patched l {_NAMES}", ("ledger", "overrides", "chart_of_accounts"))
def _(spark, view, sf):
    return overlay.overlay(view("ledger"), view("overrides"), view("chart_of_accounts")).select("entry_id", "status", "category", "debit_name", "credit_name")


@query("override_pending", _PATCHED + "SELECT b.bank_account_id, count(p.entry_id) AS pending FROM bank_accounts b LEFT JOIN patched p ON p.bank_account_id = b.bank_account_id AND p.status = 'manual_review' GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM patched WHERE status = 'manual_review'", ("ledger", "overrides", "bank_accounts"))
def _(spark, view, sf):
    return overlay.pending_by_bank(overlay.apply_changes(view("ledger"), view("overrides")), view("bank_accounts"))


@query("coa_upsert", "SELECT coalesce(n.code, c.code) AS code, coalesce(n.name, c.name) AS name, coalesce(n.type, c.type) AS type FROM chart_of_accounts c FULL OUTER JOIN incoming_accounts n ON n.code = c.code", ("chart_of_accounts", "incoming_accounts"))
def _(spark, view, sf):
    return overlay.upsert_accounts(view("chart_of_accounts"), view("incoming_accounts"))


@query("bank_code_upsert", "SELECT bank_account_id, bank, concat('2', coa_code) AS coa_code FROM bank_accounts UNION ALL SELECT 'acct-99', 'New', '1.9'", ("bank_accounts",))
def _(spark, view, sf):
    banks = view("bank_accounts")
    new = banks.select("bank_account_id", F.lit("ignored").alias("bank"), F.concat(F.lit("2"), "coa_code").alias("coa_code"))
    one = banks.agg(F.lit("acct-99").alias("bank_account_id"), F.lit("New").alias("bank"), F.lit("1.9").alias("coa_code"))
    return overlay.upsert_bank_codes(banks, new.unionByName(one))


@query("month_rebuild", f"SELECT month, count(*) AS n, {d('sum(amount)')} AS total, count(*) FILTER (WHERE status = 'pending') AS rebuilt FROM (SELECT month, amount, CASE WHEN month LIKE '1998%' THEN 'pending' ELSE status END AS status FROM ledger) z GROUP BY 1", ("ledger",))
def _(spark, view, sf):
    path = scratch(spark, "ledger-by-month")
    led = view("ledger")
    monthly.write_month(led, path)
    again = led.where(F.col("month").startswith("1998")).withColumn("status", F.lit("pending"))
    monthly.write_month(again, path)
    monthly.write_month(again, path)
    return monthly.read_month(spark, path).groupBy("month").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"), F.count_if(F.col("status") == "pending").alias("rebuilt"))


_LEFT = """led AS (SELECT * REPLACE (CASE WHEN month LIKE '1998%' THEN 'pending' ELSE status END AS status) FROM ledger WHERE month <> '1998-06')"""


@query("month_cleared", f", {_LEFT} SELECT month, count(*) AS n, {d('sum(amount)')} AS total, count(*) FILTER (WHERE status = 'pending') AS rebuilt FROM led GROUP BY 1", ("ledger",))
def _(spark, view, sf):
    path = scratch(spark, "ledger-by-month")
    led = view("ledger")
    monthly.write_month(led, path)
    again = led.where(F.col("month").startswith("1998") & (F.col("month") != "1998-06")).withColumn("status", F.lit("pending"))
    for _ in range(2):
        monthly.write_month(again, path, [f"1998-{m:02d}" for m in range(1, 13)])
    return monthly.read_month(spark, path).groupBy("month").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"), F.count_if(F.col("status") == "pending").alias("rebuilt"))


@query("month_tables", f"""SELECT l.month, count(*) AS n, count(DISTINCT l.tx_id) AS ids, {d('sum(t.amount)')} AS total, count(*) FILTER (WHERE l.status = 'manual_review') AS pending
 FROM ledger l JOIN tx t ON t.tx_id = l.tx_id WHERE l.month IN (SELECT strftime(issue_date, '%Y-%m') FROM fiscal GROUP BY 1 HAVING count(*) FILTER (WHERE cancelled) * 17 > count(*)) GROUP BY 1""", ("ledger", "tx", "fiscal"))
def _(spark, view, sf):
    """Entries with their transactions, of the months with more than one cancelled invoice in 17."""
    return month_tables_join(spark, view)[0]


def month_tables_join(spark: SparkSession, view) -> tuple[DataFrame, DataFrame]:
    """The query and the join below its totals; tests look at the plan."""
    mark = uuid.uuid4().hex
    tx = view("tx").withColumn("month", dates.month_of("tx_date"))
    led = monthly.save_month_table(view("ledger"), f"ledger_{mark}", scratch(spark, "month-ledger"), "tx_id", 8)
    tx = monthly.save_month_table(tx, f"tx_{mark}", scratch(spark, "month-tx"), "tx_id", 8)
    calendar = scratch(spark, "calendar")
    view("fiscal").groupBy(dates.month_of("issue_date").alias("month")).agg(
        F.count("*").alias("invoices"), F.count_if("cancelled").alias("cancelled")).write.parquet(calendar)
    months = spark.read.parquet(calendar).where("cancelled * 17 > invoices")
    both = monthly.in_months(led, months).join(monthly.in_months(tx, months).select("tx_id", F.col("amount").alias("signed")), "tx_id")
    return both.groupBy("month").agg(
        F.count("*").alias("n"), F.count_distinct("tx_id").alias("ids"), F.sum("signed").alias("total"),
        F.count_if(F.col("status") == "manual_review").alias("pending")), both


def _months_of(df: DataFrame, column: str) -> list[str]:
    return [r[0] for r in df.select(F.date_format(column, "yyyy-MM")).distinct().collect() if r[0]]


@query("month_publish", f""", {_LEFT}, a AS (SELECT entry_id, count(*) AS n FROM attachments GROUP BY 1),
 e AS (SELECT led.month, count(*) AS entries, {d('sum(amount)')} AS total, count(*) FILTER (WHERE status = 'pending') AS rebuilt, count(*) FILTER (WHERE status = 'manual_review') AS pending, coalesce(sum(a.n), 0)::BIGINT AS attachments
   FROM led LEFT JOIN a ON a.entry_id = led.entry_id GROUP BY 1),
 b AS (SELECT month, count(DISTINCT led.bank_account_id) AS banks FROM led JOIN bank_accounts k ON k.bank_account_id = led.bank_account_id GROUP BY 1),
 r AS (SELECT month, count(*) AS reconciliations FROM recon JOIN led ON led.tx_id = recon.tx_id GROUP BY 1),
 f AS (SELECT strftime(issue_date, '%Y-%m') AS month, count(*) AS fiscal FROM fiscal GROUP BY 1)
 SELECT e.month, entries, total, rebuilt, pending, attachments, coalesce(banks, 0) AS banks, coalesce(reconciliations, 0) AS reconciliations, coalesce(fiscal, 0) AS fiscal, entries AS imported, (SELECT count(*) FROM chart_of_accounts) AS accounts
 FROM e LEFT JOIN b ON b.month = e.month LEFT JOIN r ON r.month = e.month LEFT JOIN f ON f.month = e.month""",
    ("ledger", "attachments", "recon", "fiscal", "bank_accounts", "chart_of_accounts"))
def _(spark, view, sf):
    """All months, then those of 1998 anew (twice, June without rows), then a run that stops before its manifest."""
    root = publish.Publication(spark, scratch(spark, "published"))
    led, none = view("ledger"), spark.createDataFrame([], "doc_date date, status string")
    of = lambda entries, months: publish.month_parts(entries, view("attachments"), view("fiscal"), view("recon"), view("bank_accounts"), view("chart_of_accounts"), none, months)
    every = _months_of(led, "entry_date")
    root.publish(of(led, every), every)
    year = [f"1998-{m:02d}" for m in range(1, 13)]
    again = led.where(F.col("month").startswith("1998") & (F.col("month") != "1998-06")).withColumn("status", F.lit("pending"))
    parts = of(again, year)
    parts["accounts"] = parts["accounts"].where("month <> '1998-06'")
    for _ in range(2):
        root.publish(parts, year)
    root.stage({"entries": root.read("entries").withColumn("status", F.lit("lost"))}, every)  # never committed
    entries = root.read("entries").groupBy("month").agg(
        F.count("*").alias("entries"), F.sum("amount").alias("total"), F.count_if(F.col("status") == "pending").alias("rebuilt"),
        F.sum(F.size("attachments")).alias("in_entries"))
    banks = root.read("summary").groupBy("month").agg(F.count("*").alias("banks"))
    charts = root.read("accounts").groupBy("month").agg(F.count("*").alias("accounts"))
    out = entries.join(banks, "month", "left").join(charts, "month").join(root.read("stats").drop("fuel_documents", "fuel_linked"), "month")
    return out.where("in_entries = attachments").drop("in_entries").withColumn("banks", F.coalesce("banks", F.lit(0)))


@query("semi_month", "SELECT entry_id, file_name FROM attachments WHERE entry_id IN (SELECT entry_id FROM ledger WHERE month = '1998-10')", ("ledger", "attachments"))
def _(spark, view, sf):
    return monthly.rows_of_month(view("attachments"), view("ledger"), "entry_id", "1998-10").select("entry_id", "file_name")


@query("anti_not_in", "SELECT tx_id FROM tx WHERE tx_id NOT IN (SELECT tx_id FROM recon)", ("tx", "recon"))
def _(spark, view, sf):
    return monthly.not_in(view("tx").select("tx_id"), "tx_id", view("recon"), "tx_id")


@query("anti_not_in_null", "SELECT tx_id FROM tx WHERE counterparty_doc NOT IN (SELECT CASE WHEN cancelled THEN NULL ELSE counterparty_doc END FROM fiscal)", ("tx", "fiscal"))
def _(spark, view, sf):
    right = view("fiscal").select(F.when(~F.col("cancelled"), F.col("counterparty_doc")).alias("k"))
    return monthly.not_in(view("tx").select("tx_id", "counterparty_doc"), "counterparty_doc", right, "k").select("tx_id")


_SIDES = "SELECT 'none' AS right_side, tx_id FROM tx WHERE counterparty_doc NOT IN (SELECT counterparty_doc FROM fiscal WHERE total_value < 0) UNION ALL "


@query("anti_not_in_sides", _SIDES + "SELECT 'some', tx_id FROM tx WHERE counterparty_doc NOT IN (SELECT counterparty_doc FROM fiscal WHERE cancelled)", ("tx", "fiscal"))
def _(spark, view, sf):
    """Null keys on the left stay only where the right side is empty."""
    left = view("tx").select("tx_id", "counterparty_doc")
    parts = [("none", "total_value < 0"), ("some", "cancelled")]
    out = [monthly.not_in(left, "counterparty_doc", view("fiscal").where(c), "counterparty_doc").select(F.lit(n).alias("right_side"), "tx_id") for n, c in parts]
    return out[0].unionByName(out[1])


@query("month_stats", """, a AS (SELECT l.month, count(*) AS n FROM attachments x JOIN ledger l ON l.entry_id = x.entry_id GROUP BY 1),
 f AS (SELECT strftime(issue_date, '%Y-%m') AS month, count(*) AS n FROM fiscal GROUP BY 1), r AS (SELECT l.month, count(*) AS n FROM recon x JOIN ledger l ON l.tx_id = x.tx_id GROUP BY 1)
 SELECT l.month, count(*) AS imported, count(*) FILTER (WHERE l.status = 'manual_review') AS pending, coalesce(any_value(a.n), 0) AS attachments, coalesce(any_value(f.n), 0) AS fiscal, coalesce(any_value(r.n), 0) AS reconciliations
 FROM ledger l LEFT JOIN a ON a.month = l.month LEFT JOIN f ON f.month = l.month LEFT JOIN r ON r.month = l.month GROUP BY 1""", ("ledger", "attachments", "fiscal", "recon"))
def _(spark, view, sf):
    return monthly.month_stats(view("ledger"), view("attachments"), view("fiscal"), view("recon"))


# --- exports --------------------------------------------------------------------------

def _cell(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


@query("export_rows", f"""SELECT l.entry_id, concat('"', concat_ws('";"', strftime(l.entry_date, '%d/%m/%Y'), replace(l.description, '"', '""'), l.debit_account, coalesce(cd.name, ''), l.credit_account, coalesce(cc.name, ''), {_cell('l.amount')}, l.category, l.status, l.bank_account_id, coalesce(a.names, '')), '"') AS line
 FROM ledger l LEFT JOIN (SELECT entry_id, string_agg(file_name, '; ' ORDER BY file_name, file_type, match_type, match_score) AS names FROM attachments GROUP BY 1) a ON a.entry_id = l.entry_id {_NAMES}""", ("ledger", "attachments", "chart_of_accounts"))
def _(spark, view, sf):
    rows = export.export_rows(view("ledger"), view("chart_of_accounts"), export.nest_attachments(view("ledger"), view("attachments")))
    return rows.select("entry_id", export.csv_line([c for c in rows.columns if c != "entry_id"]).alias("line"))


@query("export_projection", f"SELECT l.entry_id, l.entry_date, l.description, l.debit_account, cd.name AS debit_name, l.credit_account, cc.name AS credit_name, {d('l.amount')} AS amount, l.category, l.status, l.bank_account_id FROM ledger l {_NAMES}", ("ledger", "chart_of_accounts"))
def _(spark, view, sf):
    return export.export_projection(view("ledger"), view("chart_of_accounts"))


@query("report_lines", """SELECT month, 2 AS part, entry_id AS key2, concat(strftime(entry_date, '%d/%m/%Y'), ' | R$ ', CAST(amount AS VARCHAR), ' | D:', debit_account, ' C:', credit_account, ' | ', description, ' [', category, ']') AS line FROM ledger
 UNION ALL SELECT l.month, 1, 0, concat(l.bank_account_id, ': entradas R$ ', CAST(CAST(sum(CASE WHEN l.debit_account = b.coa_code THEN l.amount ELSE 0 END) AS DECIMAL(18,2)) AS VARCHAR), ' | saídas R$ ', CAST(CAST(sum(CASE WHEN l.credit_account = b.coa_code THEN l.amount ELSE 0 END) AS DECIMAL(18,2)) AS VARCHAR))
 FROM ledger l JOIN bank_accounts b ON b.bank_account_id = l.bank_account_id GROUP BY l.month, l.bank_account_id
 UNION ALL SELECT month, h.part, h.key2, CASE WHEN h.line = '@' THEN concat('Empresa | Competência: ', month) ELSE h.line END FROM (SELECT DISTINCT month FROM ledger) m,
  (VALUES (0, -7, 'RAZÃO - CONCILIAÇÃO'), (0, -6, '@'), (0, -5, 'Gerado em: 01/02/2024 10:00'), (0, -4, ''), (0, -3, '--- RESUMO POR CONTA ---'), (2, -2, ''), (2, -1, '--- LANÇAMENTOS ---')) h(part, key2, line)""", ("ledger", "bank_accounts"))
def _(spark, view, sf):
    led, banks = view("ledger"), view("bank_accounts").select("bank_account_id", "coa_code")
    per_month = led.join(banks, "bank_account_id").groupBy("month", "bank_account_id").agg(
        reports.sum_if(F.col("debit_account") == F.col("coa_code")).alias("inflow"),
        reports.sum_if(F.col("credit_account") == F.col("coa_code")).alias("outflow"))
    lines = export.report_entry_lines(led).unionByName(export.report_summary_lines(per_month))
    return lines.unionByName(export.report_header_lines(led, "Empresa", "01/02/2024 10:00")).select("month", "part", "key2", "line")


# --- checks ---------------------------------------------------------------------------

@query("dq_orphan_accounts", "SELECT side, account, count(*) AS n FROM (SELECT 'debit' AS side, debit_account AS account FROM ledger UNION ALL SELECT 'credit', credit_account FROM ledger) z WHERE account NOT IN (SELECT code FROM chart_of_accounts) GROUP BY 1, 2", ("ledger", "chart_of_accounts"))
def _(spark, view, sf):
    return quality.orphan_accounts(view("ledger"), view("chart_of_accounts"))


@query("dq_enums", "SELECT 'ledger.status' AS field, label AS value, count(*) AS n FROM (SELECT CASE WHEN category LIKE 'IOF%' THEN 'odd' ELSE status END AS label FROM ledger) z WHERE label NOT IN ('matched', 'pending', 'manual_review') GROUP BY 1, 2", ("ledger",))
def _(spark, view, sf):
    led = view("ledger").withColumn("status", F.when(F.col("category").startswith("IOF"), "odd").otherwise(F.col("status")))
    return quality.enum_violations(led, view("chart_of_accounts"))


@query("dq_nulls", "SELECT count(*) FILTER (WHERE tx_date IS NULL) AS tx_date_nulls, count(*) FILTER (WHERE description IS NULL) AS description_nulls, count(*) FILTER (WHERE counterparty IS NULL) AS counterparty_nulls, count(*) FILTER (WHERE amount IS NULL) AS amount_nulls FROM tx", ("tx",))
def _(spark, view, sf):
    return quality.null_counts(view("tx"), ["tx_date", "description", "counterparty", "amount"])


@query("dq_balanced", f"SELECT month, {d('sum(amount)')} AS debits, {d('sum(amount)')} AS credits, true AS balanced FROM ledger GROUP BY 1", ("ledger",))
def _(spark, view, sf):
    return quality.balance(view("ledger"))


# --- matching and links ------------------------------------------------------------------

_GREEDY = """RECURSIVE, e AS MATERIALIZED (SELECT t.tx_id, f.fiscal_id, CASE WHEN t.counterparty_doc = f.counterparty_doc THEN 0 ELSE 1 END AS tier
  FROM {tx} t JOIN {fiscal} f ON abs(abs(t.amount) - abs(f.total_value)) <= 0.02 AND abs(date_diff('day', t.tx_date, f.issue_date)) <= 3),
 p AS MATERIALIZED (SELECT tx_id, row_number() OVER (ORDER BY tx_id) AS rn, list(fiscal_id ORDER BY tier, fiscal_id) AS docs FROM e GROUP BY tx_id),
 step(rn, used, tx_id, pick) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL SELECT p.rn, CASE WHEN list_filter(p.docs, lambda x: NOT list_contains(s.used, x))[1] IS NULL THEN s.used ELSE list_append(s.used, list_filter(p.docs, lambda x: NOT list_contains(s.used, x))[1]) END,
   p.tx_id, list_filter(p.docs, lambda x: NOT list_contains(s.used, x))[1] FROM step s JOIN p ON p.rn = s.rn + 1)
 SELECT s.tx_id, s.pick AS fiscal_id, CASE WHEN e.tier = 0 THEN 'exact' ELSE 'fuzzy' END AS match_type, CASE WHEN e.tier = 0 THEN 1.0E0 ELSE 0.7E0 END AS match_score, {confirmed} AS confirmed
 FROM step s JOIN e ON e.tx_id = s.tx_id AND e.fiscal_id = s.pick"""


@query("recon_greedy", _GREEDY.format(tx="tx", fiscal="fiscal", confirmed="true"), ("tx", "fiscal"))
def _(spark, view, sf):
    return reconcile.match_invoices(view("tx"), view("fiscal"))


@query("recon_dense", _GREEDY.format(tx="dense_tx", fiscal="dense_fiscal", confirmed="true"), ("dense_tx", "dense_fiscal"))
def _(spark, view, sf):
    return reconcile.match_invoices(view("dense_tx"), view("dense_fiscal"))


@query("recon_outgoing", _GREEDY.format(tx="(SELECT * FROM tx WHERE amount < 0)", fiscal="fiscal", confirmed="false"), ("tx", "fiscal"))
def _(spark, view, sf):
    return reconcile.match_invoices(view("tx"), view("fiscal"), direction="out", confirmed=False)


_CAND = """, e AS (SELECT t.tx_id, f.fiscal_id, coalesce(t.counterparty_doc = f.counterparty_doc, false) AS same FROM {tx} t JOIN {fiscal} f
 ON abs(abs(t.amount) - abs(f.total_value)) <= 0.02 AND abs(date_diff('day', t.tx_date, f.issue_date)) <= 3)
 SELECT tx_id, count(*) AS candidates, count(*) FILTER (WHERE same) AS same_tax_id, min(fiscal_id) AS first_candidate, min(fiscal_id) FILTER (WHERE same) AS first_same_tax_id FROM e GROUP BY 1"""


@query("recon_candidates", _CAND.format(tx="tx", fiscal="fiscal"), ("tx", "fiscal"))
def _(spark, view, sf):
    return reconcile.candidate_summary(view("tx"), view("fiscal"))


@query("recon_candidates_dense", _CAND.format(tx="dense_tx", fiscal="dense_fiscal"), ("dense_tx", "dense_fiscal"))
def _(spark, view, sf):
    return reconcile.candidate_summary(view("dense_tx"), view("dense_fiscal"))


_MATCHED = _GREEDY.format(tx="tx", fiscal="fiscal", confirmed="true")
_MATCHED = _MATCHED[:_MATCHED.index(" SELECT s.tx_id, s.pick")] + ", recon AS MATERIALIZED (SELECT tx_id, pick AS fiscal_id FROM step WHERE pick IS NOT NULL)"


@query("recon_pending", _MATCHED + f" SELECT tx_id, tx_date, description, {d('amount')} AS amount FROM tx LEFT JOIN (SELECT tx_id AS matched FROM recon) r ON r.matched = tx.tx_id WHERE r.matched IS NULL", ("tx", "fiscal"))
def _(spark, view, sf):
    matches = reconcile.match_invoices(view("tx"), view("fiscal"))
    return reconcile.unreconciled(view("tx"), matches).select("tx_id", "tx_date", "description", "amount")


@query("recon_stats", _MATCHED + " SELECT count(r.tx_id) AS matched, count(*) - count(r.tx_id) AS unmatched_bank FROM tx t LEFT JOIN recon r ON r.tx_id = t.tx_id", ("tx", "fiscal"))
def _(spark, view, sf):
    return reconcile.match_counts(view("tx"), reconcile.match_invoices(view("tx"), view("fiscal")))


@query("card_settlement", f"""SELECT t.tx_id, t.tx_date, {d('t.amount')} AS bank_amount, {d('x.s')} AS expected_sales, {d('round(t.amount - x.s, 2)')} AS diff,
 CASE WHEN abs(t.amount - x.s) <= 0.02 THEN 'ok' ELSE 'diverge ⚠️' END AS status FROM tx t JOIN (SELECT CAST(l_shipdate AS DATE) AS dt, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS s FROM lineitem GROUP BY 1) x ON x.dt = t.tx_date""", ("tx",))
def _(spark, view, sf):
    expected = sample.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("tx_date")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("expected_sales"))
    return reconcile.card_settlements(view("tx"), expected)


@query("fiscal_with_path", f"SELECT f.fiscal_id, s.path, {d('f.total_value')} AS total_value FROM fiscal f JOIN (SELECT md5(xml_path) AS file_id, xml_path AS path FROM fiscal WHERE NOT cancelled) s ON s.file_id = md5(f.xml_path)", ("fiscal",))
def _(spark, view, sf):
    source_files = view("fiscal").where("NOT cancelled").select(F.md5("xml_path").alias("file_id"), F.col("xml_path").alias("path"))
    return view("fiscal").withColumn("file_id", F.md5("xml_path")).join(source_files, "file_id").select("fiscal_id", "path", "total_value")


def _files(view) -> DataFrame:
    return view("files").withColumn("kind", fn.file_kind("path")).withColumn("ext", fn.extension("path"))


_PDF_SQL = """SELECT fiscal_id, path AS pdf_path, place FROM (SELECT f.fiscal_id, p.path, CASE WHEN regexp_extract(f.xml_path, '^(.*)/[^/]*$', 1) = regexp_extract(p.path, '^(.*)/[^/]*$', 1) THEN 1
  WHEN regexp_extract(regexp_extract(f.xml_path, '^(.*)/[^/]*$', 1), '^(.*)/[^/]*$', 1) = regexp_extract(p.path, '^(.*)/[^/]*$', 1) THEN 3 END AS place
 FROM fiscal f JOIN files p ON p.file_name = concat(lpad(f.doc_number, 44, '0'), '.pdf')) z WHERE place IS NOT NULL"""


@query("invoice_pdf", _PDF_SQL, ("fiscal", "files"))
def _(spark, view, sf):
    return links.invoice_pdfs(view("fiscal"), view("files"))


def _serial(choose: str, lists: str) -> str:
    """Rows of ``p`` (rn from 1 and ``lists``) in turn; ``choose`` names what a row takes of its lists, given the list ``used``."""
    return f""", step(rn, used, pick) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
  UNION ALL SELECT rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick
   FROM (SELECT p.rn, s.used, {choose} AS pick FROM step s JOIN p ON p.rn = s.rn + 1) z)
"""


def _free(column: str) -> str:
    return f"list_filter(p.{column}, lambda x: NOT list_contains(s.used, x))"


def _receipts(view) -> tuple[DataFrame, DataFrame]:
    return links.client_receipts(view("ledger")), links.receipt_invoices(view("fiscal"), links.invoice_pdfs(view("fiscal"), view("files")))


_NORM = "regexp_replace(strip_accents(upper(coalesce({x}, ''))), '[^A-Z0-9]', '', 'g')"
_RECEIPTS = f""", en AS (SELECT entry_id, amount, entry_date, client, {_NORM.format(x='client')} AS cn FROM (SELECT *,
   CASE WHEN description LIKE 'Pix - Recebido 01/06%' THEN trim(concat(substr(description, 42), ' ', coalesce(counterparty, '')))
    WHEN description LIKE 'Pix - Recebido%' THEN trim(concat(substr(description, 16), ' ', coalesce(counterparty, ''))) ELSE counterparty END AS client
   FROM ledger WHERE category ILIKE '%cliente%' AND debit_account = bank_coa) z),
 dc AS (SELECT fiscal_id, total_value, issue_date, counterparty_name AS receiver, {_NORM.format(x='counterparty_name')} AS dn FROM fiscal WHERE NOT cancelled),
 e AS (SELECT en.entry_id, en.client IS NOT NULL AND receiver IS NOT NULL AND (contains(cn, dn) OR contains(dn, cn)) AS named, en.client IS NULL AS open_, receiver IS NULL AS bare
  FROM en JOIN dc ON abs(en.amount - dc.total_value) <= 0.05 AND abs(date_diff('day', en.entry_date, dc.issue_date)) <= 7)
 SELECT entry_id, CAST(count(*) FILTER (WHERE named) AS BIGINT) AS named, CAST(count(*) FILTER (WHERE bare AND NOT open_) AS BIGINT) AS nameless, CAST(count(*) FILTER (WHERE open_) AS BIGINT) AS any_invoice
 FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE named) + count(*) FILTER (WHERE bare) + count(*) FILTER (WHERE open_) > 0"""


@query("receipt_candidates", _RECEIPTS, ("ledger", "fiscal"))
def _(spark, view, sf):
    return links.receipt_candidates(*_receipts(view))


_RECEIPT_GREEDY = "RECURSIVE" + _RECEIPTS[:_RECEIPTS.index(" dc AS (")] + f""" pd AS ({_PDF_SQL}),
 dc AS (SELECT f.fiscal_id, total_value, issue_date, counterparty_name AS receiver, {_NORM.format(x='counterparty_name')} AS dn, xml_path, pdf_path,
   0.7E0 + CASE WHEN pdf_path IS NULL THEN 0 ELSE 0.05E0 END AS plain, counterparty_name IS NULL AND doc_model = '65' AS bare65
   FROM fiscal f LEFT JOIN pd ON pd.fiscal_id = f.fiscal_id WHERE NOT cancelled AND doc_model IN ('55', '65')),
 e AS (SELECT en.entry_id, dc.fiscal_id, en.client IS NULL AS open_, receiver IS NULL AS bare, round(plain + CASE WHEN en.client IS NOT NULL AND receiver IS NOT NULL THEN 0.25E0 WHEN bare65 THEN 0.05E0 ELSE 0 END, 2) AS score,
   CASE WHEN en.client IS NULL THEN true WHEN receiver IS NULL THEN true ELSE length(cn) >= 4 AND length(dn) >= 4 AND (contains(cn, dn) OR contains(dn, cn)) END AS ok
  FROM en JOIN dc ON abs(en.amount - dc.total_value) <= 0.05 AND abs(date_diff('day', en.entry_date, dc.issue_date)) <= 7),
 p AS (SELECT entry_id, row_number() OVER (ORDER BY entry_id) AS rn, coalesce(list(fiscal_id ORDER BY score DESC, fiscal_id) FILTER (WHERE open_ OR NOT bare), []) AS docs,
   coalesce(list(fiscal_id) FILTER (WHERE bare AND NOT open_), []) AS bares FROM e WHERE ok GROUP BY entry_id)""" + _serial(
    f"coalesce({_free('docs')}[1], CASE WHEN len({_free('bares')}) = 1 THEN {_free('bares')}[1] END)", "docs, bares") + """,
 m AS (SELECT p.entry_id, fiscal_id, score FROM step JOIN p USING (rn) JOIN e ON e.entry_id = p.entry_id AND e.fiscal_id = pick),
 rows AS (SELECT m.entry_id, pdf_path AS file_path, 'DANFE — ' AS label, score FROM m JOIN dc USING (fiscal_id) WHERE pdf_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pdf_path ORDER BY m.entry_id, fiscal_id) = 1
  UNION ALL SELECT m.entry_id, xml_path, 'XML NF-e — ', score FROM m JOIN dc USING (fiscal_id) WHERE xml_path IS NOT NULL)
 SELECT entry_id, file_path, label || regexp_extract(file_path, '[^/]*$') AS file_name, CASE WHEN score >= 0.9 THEN 'exact' ELSE 'fuzzy' END AS match_type, score AS match_score FROM rows"""


@query("receipt_greedy", _RECEIPT_GREEDY, ("ledger", "fiscal", "files"))
def _(spark, view, sf):
    entries, docs = _receipts(view)
    return links.receipt_attachments(links.match_receipts(entries, docs), docs).select("entry_id", "file_path", "file_name", "match_type", "match_score")


_SUPPLIER = f", sp AS (SELECT entry_id, amount, entry_date, {_NORM.format(x='coalesce(counterparty, regexp_extract(description, ' + repr('Cp :[0-9]+-(.+)$') + ', 1))')} AS sn FROM ledger WHERE debit_account <> bank_coa AND category ILIKE '%fornecedor%')\n"


@query("supplier_invoice", _SUPPLIER + f"""SELECT sp.entry_id, min(f.fiscal_id) AS fiscal_id FROM sp JOIN (SELECT *, {_NORM.format(x='counterparty_name')} AS dn FROM fiscal) f
 ON abs(sp.amount - f.total_value) <= 0.05 AND abs(date_diff('day', sp.entry_date, f.issue_date)) <= 30 AND dn <> '' AND length(sn) >= 3 AND (contains(sn, dn) OR contains(dn, sn)) GROUP BY 1""", ("ledger", "fiscal"))
def _(spark, view, sf):
    return links.supplier_invoices(links.supplier_payments(view("ledger")), view("fiscal"))


_FIRST_FILE = """ SELECT sn AS sname, min(file_id) AS file_id FROM (SELECT DISTINCT sn FROM sp WHERE length(sn) >= 3) s JOIN (SELECT file_id, {norm} AS nf FROM files WHERE {cond}) f ON contains(s.sn, f.nf) OR contains(f.nf, s.sn) GROUP BY 1"""


@query("supplier_fallback", _SUPPLIER + _FIRST_FILE.format(norm=_NORM.format(x="file_name"), cond="path LIKE '%NOTAS FISCAL DE ENTRADA%'"), ("ledger", "files"))
def _(spark, view, sf):
    names = links.supplier_payments(view("ledger")).select("sname").distinct()
    return links.first_named_file(names, "sname", links.inbound_pdfs(_files(view)))


@query("supplier_receipt", _SUPPLIER + _FIRST_FILE.format(norm=_NORM.format(x="path"), cond="path LIKE '%COMPROVANTES%'"), ("ledger", "files"))
def _(spark, view, sf):
    names = links.supplier_payments(view("ledger")).select("sname").distinct()
    return links.first_named_file(names, "sname", links.slip_files(_files(view)), by_path=True)


@query("deduction_receipt", f""", en AS (SELECT entry_id, {_NORM.format(x="coalesce(counterparty, description)")} AS n FROM ledger WHERE category ILIKE '%pensão alimentícia%' AND entry_id NOT IN (SELECT entry_id FROM attachments)),
 f AS (SELECT file_id, {_NORM.format(x="file_name")} AS nf, {_NORM.format(x="path")} AS np FROM files WHERE path LIKE '%COMPROVANTES%'),
 nm AS (SELECT n, min(file_id) AS file_id FROM (SELECT DISTINCT n FROM en) q JOIN f ON contains(nf, n) OR contains(n, nf) OR contains(np, n) OR contains(n, np) OR left(n, 6) = left(nf, 6) OR left(n, 6) = left(np, 6) GROUP BY 1)
 SELECT en.entry_id, files.path AS file_path, 1.0E0 AS match_score FROM en JOIN nm ON nm.n = en.n JOIN files ON files.file_id = nm.file_id""", ("ledger", "attachments", "files"))
def _(spark, view, sf):
    return links.deduction_attachments(view("ledger"), _files(view), view("attachments")).select("entry_id", "file_path", "match_score")


_ATTACH = f""", fx AS (SELECT file_id, path, bank_account_id AS bank, {_NORM.format(x='file_name')} AS fn,
   try_strptime(nullif(regexp_extract(file_name, '^[0-9]+ - ([0-9]{{8}}) - [^-]+ - [0-9.,]+', 1), ''), '%d%m%Y')::DATE AS slip_day,
   CAST(round(CAST(replace(nullif(regexp_extract(file_name, '^[0-9]+ - [0-9]{{8}} - [^-]+ - ([0-9,]+)', 1), ''), ',', '.') AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents,
   try_strptime(nullif(regexp_extract(file_name, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), ''), '%Y-%m-%d')::DATE AS iso, {_NORM.format(x="regexp_extract(file_name, '_([^_]+)[.]pdf$', 1)")} AS payee FROM files),
 ex AS (SELECT entry_id, entry_date AS day, bank_account_id AS bank, CAST(round(abs(amount) * 100) AS BIGINT) AS cents, {_NORM.format(x='counterparty')} AS cn, {_NORM.format(x='description')} AS dn,
   {_NORM.format(x="coalesce(nullif(counterparty, ''), description)")} AS who FROM ledger),
 byv AS (SELECT entry_id, file_id, e.bank = f.bank AS own, CASE WHEN slip_day = day THEN 1 WHEN abs(slip_day - day) <= 2 THEN 3 WHEN iso IS NOT NULL AND abs(iso - day) <= 2 THEN NULL
    WHEN f.cents > 0 AND ({{n1}} OR {{n2}}) THEN 5 END AS tier FROM ex e JOIN fx f ON f.cents BETWEEN e.cents - 5 AND e.cents + 5 WHERE slip_day IS NOT NULL),
 byd AS (SELECT entry_id, file_id, e.bank = f.bank AS own, CASE WHEN {{n3}} THEN 6 END AS tier FROM ex e JOIN fx f ON f.iso BETWEEN e.day - 2 AND e.day + 2 WHERE f.cents IS NULL OR f.slip_day IS NULL),
 e AS (SELECT entry_id, file_id, min(tier - coalesce(own, false)::INT) AS tier FROM (SELECT * FROM byv UNION ALL SELECT * FROM byd) z WHERE tier IS NOT NULL GROUP BY ALL),
 sc AS (SELECT * FROM (VALUES (0, 1.05E0), (1, 1.0E0), (2, 0.95E0), (3, 0.9E0), (4, 0.85E0), (5, 0.8E0), (6, 0.75E0)) v(tier, score))
"""
for _k, (_a, _b) in {"n1": ("fn", "cn"), "n2": ("fn", "dn"), "n3": ("payee", "who")}.items():
    _ATTACH = _ATTACH.replace("{" + _k + "}", f"({_a} <> '' AND {_b} <> '' AND (contains({_a}, {_b}) OR contains({_b}, {_a}) OR left({_a}, 6) = left({_b}, 6)))")


@query("attach_candidates", _ATTACH + """SELECT entry_id, file_id, score FROM (SELECT entry_id, min_by(file_id, (tier, file_id)) AS file_id, min(tier) AS tier FROM e GROUP BY entry_id) b JOIN sc USING (tier)""", ("ledger", "files"))
def _(spark, view, sf):
    return links.file_candidates(links.file_entries(view("ledger")), links.attachable(_files(view)))


@query("attach_greedy", "RECURSIVE" + _ATTACH + """, p AS (SELECT entry_id, row_number() OVER (ORDER BY entry_id) AS rn, list(file_id ORDER BY tier, file_id) AS docs FROM e GROUP BY entry_id)"""
       + _serial(_free("docs") + "[1]", "docs") + """ SELECT p.entry_id, fx.path AS file_path, CASE WHEN score >= 0.95 THEN 'exact' ELSE 'fuzzy' END AS match_type, score AS match_score
 FROM step JOIN p USING (rn) JOIN e ON e.entry_id = p.entry_id AND e.file_id = pick JOIN sc USING (tier) JOIN fx ON fx.file_id = pick""", ("ledger", "files"))
def _(spark, view, sf):
    return links.file_attachments(view("ledger"), _files(view)).select("entry_id", "file_path", "match_type", "match_score")


def _fuel(view) -> tuple[DataFrame, DataFrame]:
    return documents.fuel_receipts(view("fuel_docs")), links.fuel_entries(view("fuel_spend"))


@query("fuel_candidates", """SELECT d.doc_id, coalesce(s.n, 0) AS same_day, coalesce(p.n, 0) + coalesce(q.n, 0) AS next_days FROM fuel_docs d
 LEFT JOIN (SELECT entry_date, count(*) AS n FROM fuel_spend GROUP BY 1) s ON s.entry_date = d.modified LEFT JOIN (SELECT entry_date, count(*) AS n FROM fuel_spend GROUP BY 1) p ON p.entry_date = d.modified - 1
 LEFT JOIN (SELECT entry_date, count(*) AS n FROM fuel_spend GROUP BY 1) q ON q.entry_date = d.modified + 1""", ("fuel_docs", "fuel_spend"))
def _(spark, view, sf):
    docs, entries = _fuel(view)
    per_day = entries.groupBy("day").agg(F.count("*").alias("n"))
    reach = per_day.select(F.explode(F.array(*[F.struct((F.col("day") + k).alias("day"), F.lit(k).alias("k"), "n") for k in (-1, 0, 1)])).alias("x")).select("x.*")
    near = reach.groupBy("day").agg(F.sum(F.when(F.col("k") == 0, F.col("n"))).alias("s"), F.sum(F.when(F.col("k") != 0, F.col("n"))).alias("o"))
    return docs.withColumn("day", dates.day_number("doc_date")).join(near, "day", "left").select(
        "doc_id", F.coalesce("s", F.lit(0)).alias("same_day"), F.coalesce("o", F.lit(0)).alias("next_days"))


_FUEL = f"""RECURSIVE, dt AS (SELECT doc_id, modified AS doc_date, CASE WHEN file_name LIKE 'Scan%' THEN concat(substr(file_name, 15, 2), ':', substr(file_name, 17, 2)) WHEN file_name LIKE 'Digi%' THEN concat(substr(file_name, 23, 2), ':', substr(file_name, 25, 2)) END AS doc_time, file_name FROM fuel_docs),
 dm AS (SELECT *, CAST(left(doc_time, 2) AS INT) * 60 + CAST(right(doc_time, 2) AS INT) AS minute FROM dt),
 em AS (SELECT entry_id, entry_date, CAST(regexp_extract(description, '([0-9][0-9]):([0-9][0-9])', 1) AS INT) * 60 + CAST(regexp_extract(description, '([0-9][0-9]):([0-9][0-9])', 2) AS INT) AS minute FROM fuel_spend),
 sd AS (SELECT doc_id, entry_id, CASE WHEN abs(d.minute - e.minute) <= 30 THEN 0.98E0 WHEN abs(d.minute - e.minute) <= 120 THEN 0.85E0 ELSE 0.7E0 END AS score FROM dm d JOIN em e ON e.entry_date = d.doc_date),
 nd AS (SELECT doc_id, entry_id FROM dm d JOIN em e ON e.entry_date IN (d.doc_date - 1, d.doc_date + 1)),
 sl AS (SELECT doc_id, list(entry_id ORDER BY score DESC, entry_id) AS docs FROM sd GROUP BY doc_id),
 nl AS (SELECT doc_id, list(entry_id) AS near FROM nd GROUP BY doc_id),
 p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_date, doc_id) AS rn, coalesce(docs, []) AS docs, coalesce(near, []) AS near FROM dm LEFT JOIN sl USING (doc_id) LEFT JOIN nl USING (doc_id) WHERE doc_date IS NOT NULL)""" + _serial(
    f"coalesce({_free('docs')}[1], CASE WHEN len({_free('near')}) = 1 THEN {_free('near')}[1] END)", "docs, near") + f""",
 m AS (SELECT p.doc_id, pick AS entry_id, CASE WHEN NOT list_contains(p.docs, pick) THEN 0.6E0 WHEN len(list_filter(p.docs, lambda x: NOT list_contains(s.used, x) OR x = pick)) = 1 THEN 0.95E0 ELSE sd.score END AS score
   FROM step s JOIN p USING (rn) LEFT JOIN sd ON sd.doc_id = p.doc_id AND sd.entry_id = pick WHERE pick IS NOT NULL),
 rec AS (SELECT d.doc_id, d.file_name, d.doc_date, d.doc_time, {d('f.amount')} AS amount, f.bank_account_id, m.entry_id, coalesce(f.category, 'Despesa combustível') AS category, coalesce(f.debit_account, '{links.FUEL_DEFAULT_ACCOUNT}') AS debit_account,
   CASE WHEN m.entry_id IS NULL THEN 'documento' ELSE 'conciliado' END AS status, m.score FROM dm d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN fuel_spend f ON f.entry_id = m.entry_id)
"""


@query("fuel_link", _FUEL + "SELECT rec.*, coalesce(nullif(f.counterparty, ''), nullif(regexp_replace(f.description, '.*POSTO', 'POSTO'), '')) AS station FROM rec LEFT JOIN fuel_spend f ON f.entry_id = rec.entry_id", ("fuel_docs", "fuel_spend"))
def _(spark, view, sf):
    docs, entries = _fuel(view)
    return links.fuel_records(docs, entries, links.match_fuel(docs, entries))


@query("fuel_stats", _FUEL + "SELECT count(*) AS documents, count(entry_id) AS linked, count(*) - count(entry_id) AS document_only, sum(amount) AS total FROM rec", ("fuel_docs", "fuel_spend"))
def _(spark, view, sf):
    docs, entries = _fuel(view)
    return reports.receipt_counts(links.fuel_records(docs, entries, links.match_fuel(docs, entries)))


@query("fuel_refresh", _FUEL + """, fr AS (SELECT strftime(doc_date, '%Y-%m') AS month, count(*) AS fuel_documents, count(entry_id) AS fuel_linked, sum(amount) AS total FROM rec WHERE doc_date IS NOT NULL GROUP BY 1),
 en AS (SELECT month, count(*) AS imported FROM ledger GROUP BY 1)
 SELECT coalesce(fr.month, en.month) AS month, coalesce(imported, 0) AS imported, coalesce(fuel_documents, 0) AS fuel_documents, coalesce(fuel_linked, 0) AS fuel_linked, total, coalesce(imported, 0) AS entries
 FROM fr FULL JOIN en ON en.month = fr.month""", ("fuel_docs", "fuel_spend", "ledger"))
def _(spark, view, sf):
    """Published before any receipt was linked; then only the fuel part and its two counters are replaced."""
    docs, entries = _fuel(view)
    root = publish.Publication(spark, scratch(spark, "published"))
    led = view("ledger")
    months = sorted({*_months_of(led, "entry_date"), *_months_of(docs, "doc_date")})
    unlinked = links.fuel_records(docs, entries, spark.createDataFrame([], "doc_id long, entry_id long, score double"))
    parts = publish.month_parts(led, view("attachments"), view("fiscal"), view("recon"), view("bank_accounts"), view("chart_of_accounts"), unlinked, months)
    root.publish({n: parts[n] for n in ("entries", "fuel_records", "stats")}, months)
    linked = links.fuel_records(docs, entries, links.match_fuel(docs, entries))
    root.publish(publish.fuel_parts(root, linked, months), months)
    sums = root.read("fuel_records").groupBy("month").agg(F.sum("amount").alias("total"))
    kept = root.read("entries").groupBy("month").agg(F.count("*").alias("entries"))
    return root.read("stats").select("month", "imported", "fuel_documents", "fuel_linked").join(sums, "month", "left").join(kept, "month", "left").na.fill(0, ["entries"])


@query("receipt_search", _FUEL + "SELECT doc_id FROM (SELECT rec.*, coalesce(nullif(f.counterparty, ''), nullif(regexp_replace(f.description, '.*POSTO', 'POSTO'), '')) AS station FROM rec LEFT JOIN fuel_spend f ON f.entry_id = rec.entry_id) z WHERE contains(lower(concat_ws(' ', file_name, station, CAST(doc_date AS VARCHAR))), 'posto central')", ("fuel_docs", "fuel_spend"))
def _(spark, view, sf):
    docs, entries = _fuel(view)
    return reports.search_text(links.fuel_records(docs, entries, links.match_fuel(docs, entries)), "Posto Central", reports.RECEIPT_SEARCH).select("doc_id")


@query("attachments_all")
def _(spark, view, sf):
    fuel = documents.fuel_receipts(view("fuel_docs"))
    return links.link_all(view("ledger"), view("fiscal"), _files(view), fuel).select("entry_id", "file_path", "file_name", "match_type", "match_score", "stage")
