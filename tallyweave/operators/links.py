"""Linking documents to ledger entries, stage by stage.

Inputs:

* ledger: ``entry_id, entry_date, description, counterparty, bank_account_id,
  bank_coa, category, amount, debit_account``
* fiscal: ``fiscal_id, issue_date, counterparty_name, doc_model, total_value,
  cancelled, xml_path``
* files: ``file_id, path, file_name, kind, ext, bank_account_id, size``

Names are compared on distinct normalised names only (``operators.names``);
amounts and dates meet through bounded keys (``reconcile.cell_lists``);
exclusive choices go through ``matching.greedy_assign``. Entry and file ids
give the order the reference order of work would have.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyweave.functions import filenames as fn
from tallyweave.functions.accounts import FUEL_DEFAULT_ACCOUNT, LINKED, UNLINKED, fuel_linkable
from tallyweave.functions.dates import day_number, minutes_in_text
from tallyweave.functions.money import LINK_CENTS, cents
from tallyweave.functions.text import client_name, matches_any, normalize_name, station_name, supplier_name
from tallyweave.operators.matching import greedy_assign
from tallyweave.operators.names import containment, first_holding, holds
from tallyweave.operators.ranking import ranked, running
from tallyweave.operators.reconcile import block, blocks, cell_lists, near_value, within
from tallyweave.session import cut, many, once

# Date windows in days and labels put before file names.
RECEIPT_DAYS, SUPPLIER_DAYS, FILE_DAYS = 7, 30, 2
DANFE, XML, INBOUND_PDF, INBOUND_XML = "DANFE — ", "XML NF-e — ", "DANFE entrada — ", "XML NF entrada — "
INBOUND, SLIP, FUEL = "NF entrada — ", "Comprovante PIX — ", "Cupom combustível — "
INBOUND_FOLDER = r"(?i)NOTAS FISCAL DE ENTRADA"


def with_flow(ledger: DataFrame) -> DataFrame:
    """Whether money came in or went out, by ``signed_amount``.

    A ledger without that column (one read back from an export) is judged by which side
    its bank stands on.
    """
    if "signed_amount" in ledger.columns:
        return ledger.withColumn("inflow", F.col("signed_amount") > 0).withColumn("outflow", F.col("signed_amount") < 0)
    at_bank = F.col("debit_account") == F.col("bank_coa")
    return ledger.withColumn("inflow", at_bank).withColumn("outflow", ~at_bank)


def invoice_pdfs(fiscal: DataFrame, files: DataFrame) -> DataFrame:
    """Per invoice the PDF named by its 44-digit key, from the first of the known folders."""
    pdfs = files.where(F.lower("file_name").rlike(r"^\d{44}\.pdf$")).select(
        F.left("file_name", F.lit(44)).alias("key"),
        F.col("path").alias("pdf_path"),
        F.regexp_extract(fn.slashes("path"), r"^(.*)/[^/]*$", 1).alias("at"),
    )
    docs = fiscal.select(
        "fiscal_id", "xml_path", fn.invoice_key("xml_path").alias("key"),
        F.regexp_extract(fn.slashes("xml_path"), r"^(.*)/[^/]*$", 1).alias("d"),
    ).withColumn("p", F.regexp_extract("d", r"^(.*)/[^/]*$", 1)).withColumn("g", F.regexp_extract("p", r"^(.*)/[^/]*$", 1))
    at = F.col("at")
    rank = (
        F.when(at == F.col("d"), 1).when(at == F.concat("p", F.lit("/PDF")), 2).when(at == F.col("p"), 3)
        .when(at == F.concat("g", F.lit("/PDF")), 4).when(at == F.concat("d", F.lit("/DANFE")), 5)
    )
    return docs.join(pdfs, "key").withColumn("place", rank).where("place IS NOT NULL").groupBy("fiscal_id").agg(
        F.min_by("pdf_path", F.struct("place", "pdf_path")).alias("pdf_path"), F.min("place").alias("place")
    )


def _attachment(stage: str, path: Column, name: Column, kind: Column, score: Column, exact_from: float, size: Column | None = None) -> list[Column]:
    return [
        F.col("entry_id"), path.alias("file_path"), name.alias("file_name"), kind.alias("file_type"),
        (F.lit(None) if size is None else size).cast("long").alias("file_size"),
        F.when(score >= exact_from, "exact").otherwise("fuzzy").alias("match_type"),
        score.cast("double").alias("match_score"), F.lit(stage).alias("stage"),
    ]


# --- receipts -------------------------------------------------------------

def client_receipts(ledger: DataFrame, own: list[str] = (), partners: list[str] = ()) -> DataFrame:
    """Incoming client entries, own company and partners left out, with the payer's normalised name."""
    hay = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("counterparty", F.lit("")))
    own_hit, partner_hit = matches_any(hay, list(own)), matches_any(hay, list(partners))
    return (
        with_flow(ledger).where(F.col("inflow") & F.col("category").ilike("%cliente%") & ~own_hit & ~partner_hit)
        .select(
            F.col("entry_id").alias("left_id"), cents("amount").alias("cents"), day_number("entry_date").alias("day"),
            F.nullif(client_name("description", "counterparty", F.lit(False), F.lit(False)), F.lit("")).alias("client"),
        )
        .withColumn("cname", F.when(F.col("client").isNotNull(), normalize_name("client")))
    )


def receipt_invoices(fiscal: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Valid invoices of both models with the normalised receiver name and whether a PDF exists."""
    ok = ~F.coalesce("cancelled", F.lit(False)) & F.col("doc_model").try_cast("int").isin(55, 65)
    return fiscal.where(ok).join(pdfs.select("fiscal_id", "pdf_path"), "fiscal_id", "left").select(
        F.col("fiscal_id").alias("right_id"), cents("total_value").alias("cents"), day_number("issue_date").alias("day"),
        F.nullif("counterparty_name", F.lit("")).alias("receiver"), "doc_model", "pdf_path", "xml_path",
    ).withColumn("dname", F.when(F.col("receiver").isNotNull(), normalize_name("receiver"))).where(
        "cents IS NOT NULL AND day IS NOT NULL")


def _key(*parts) -> Column:
    return F.concat_ws("|", *[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else (F.col(p) if isinstance(p, str) else p) for p in parts])


def receipt_lists(entries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``left_lists``, ``lists`` and the nameless lists.

    A payer with a name takes matching names only (with PDF first); without a
    name any invoice will do, by score. Nameless invoices for named payers are
    decided in ``match_receipts``.
    """
    entries, docs = cut(entries, "receipt-entries"), cut(docs, "receipt-docs")
    pairs = containment(
        entries.select("cname").where(F.length("cname") >= 4), "cname", docs.select("dname").where(F.length("dname") >= 4), "dname"
    )
    named_docs = docs.join(pairs, "dname").select(
        "right_id", "cname", F.col("cents").alias("r_cents"), F.col("day").alias("r_day"), F.col("pdf_path").isNotNull().alias("pdf")
    )
    near = named_docs.withColumn("_c", blocks(F.col("r_cents"), LINK_CENTS)).withColumn("_b", blocks(F.col("r_day"), RECEIPT_DAYS))
    classes = entries.where("cname IS NOT NULL").select("cents", "day", "cname").distinct()
    keyed = classes.withColumn("_c", block("cents", LINK_CENTS)).withColumn("_b", block("day", RECEIPT_DAYS))
    hit = keyed.join(many(near), ["cname", "_c", "_b"]).where(within("cents", "r_cents", LINK_CENTS) & within("day", "r_day", RECEIPT_DAYS))
    named = hit.select(_key(F.when(F.col("pdf"), "np").otherwise("n"), "cents", "day", "cname").alias("list_id"), "right_id")
    any_docs = docs.select(
        "right_id", "cents", "day",
        F.when(F.col("receiver").isNull() & (F.col("doc_model") == "65"), F.lit(1)).otherwise(F.lit(0)).alias("bare65"),
        F.col("pdf_path").isNotNull().cast("int").alias("pdf"),
    )
    open_cells = entries.where("client IS NULL").select("cents", "day").distinct()
    level = F.concat(F.lit("a"), (F.lit(2) - F.col("bare65") - F.col("pdf")).cast("string"))
    open_ = cell_lists(open_cells, any_docs, LINK_CENTS, RECEIPT_DAYS).select(_key(level, "cents", "day").alias("list_id"), "right_id")
    named_cells = entries.where("client IS NOT NULL").select("cents", "day").distinct()
    bare = docs.where("receiver IS NULL").select("right_id", "cents", "day")
    nameless = cell_lists(named_cells, bare, LINK_CENTS, RECEIPT_DAYS).select(_key("=z", "cents", "day").alias("list_id"), "right_id")
    tiers = F.when(
        F.col("client").isNotNull(),
        F.array(
            F.struct(F.lit(0).alias("tier"), _key("=np", "cents", "day", "cname").alias("list_id")),
            F.struct(F.lit(1).alias("tier"), _key("=n", "cents", "day", "cname").alias("list_id")),
        ),
    ).otherwise(
        F.array(*[F.struct(F.lit(10 + i).alias("tier"), _key(f"=a{i}", "cents", "day").alias("list_id")) for i in range(3)])
    )
    return entries.select("left_id", near_value("cents").alias("place"), F.inline(tiers)), named.unionByName(open_), nameless


# Score per tier; tier 2 is a nameless invoice taken by a named payer, scored from the invoice.
RECEIPT_SCORES = {0: 1.0, 1: 0.95, 10: 0.8, 11: 0.75, 12: 0.7}


def _tier_two(choice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nameless invoice chosen for each payer as a list of its own."""
    own = F.concat(F.lit("x|"), F.col("left_id").cast("string"))
    lefts = choice.select("left_id", F.lit(None).cast("string").alias("place"), F.lit(2).alias("tier"), own.alias("list_id"))
    return lefts, choice.select(own.alias("list_id"), "right_id")


def _touched(seed: DataFrame, left_lists: DataFrame, lists: DataFrame) -> DataFrame:
    """``left_id`` of the connected groups of the candidate graph that hold a row of ``seed``.

    A search from the changed rows outwards: each round follows only the rows that are
    new (their lists, the lists' invoices, all lists that hold those, and the rows that
    name them), so groups without a changed row are never visited.
    """
    new = cut(seed.select("left_id").distinct(), "touched")
    lefts, rights = [new], []
    while True:
        found = lists.join(left_lists.join(new, "left_id", "left_semi").select("list_id").distinct(), "list_id", "left_semi").select("right_id").distinct()
        for known in rights:
            found = found.join(known, "right_id", "left_anti")
        found = cut(found, "touched")
        rights.append(found)
        held_in = lists.join(found, "right_id", "left_semi").select("list_id").distinct()
        new = left_lists.join(held_in, "list_id", "left_semi").select("left_id").distinct()
        for known in lefts:
            new = new.join(known, "left_id", "left_anti")
        new = cut(new, "touched")
        if new.isEmpty():
            out = lefts[0]
            for more in lefts[1:]:
                out = out.unionByName(more)
            return out
        lefts.append(new)


def match_receipts(entries: DataFrame, docs: DataFrame, trace: list[int] | None = None) -> DataFrame:
    """Exclusive receipt-invoice matches.

    A named payer without a matching name left takes a nameless invoice only
    when exactly one is left in reach at its turn. Whether that holds depends
    on what earlier payers took, so the choices are repeated until they agree
    with the matches they produce. Each pass settles at least the earliest
    payer still wrong, so the passes end, and an agreeing state is the sequential result.

    The first pass matches all rows. A later one matches again only the connected groups
    that hold a payer whose choice changed, and looks again only at the choices of payers
    in reach of an invoice whose holder changed. ``trace`` receives the payers matched in
    each pass.
    """
    entries, docs = cut(entries, "receipt-entries"), cut(docs, "receipt-docs")
    left_lists, lists, nameless = (cut(x, "receipts") for x in receipt_lists(entries, docs))
    asks = entries.where("client IS NOT NULL").select("left_id", _key("=z", "cents", "day").alias("list_id"))
    totals = nameless.groupBy("list_id").agg(
        F.count("*").alias("n"), F.sum(F.col("right_id").cast("decimal(38,0)")).alias("ids"))
    asks = cut(asks.join(totals, "list_id"), "asks")

    def match(choice: DataFrame, of: DataFrame | None = None) -> DataFrame:
        two, two_lists = _tier_two(choice)
        mine = left_lists.unionByName(two)
        if of is not None:
            mine = cut(mine.join(of, "left_id", "left_semi"), "touched-lists")
            return greedy_assign(mine, lists.unionByName(two_lists).join(mine.select("list_id").distinct(), "list_id", "left_semi"))
        return greedy_assign(mine, lists.unionByName(two_lists))

    def choices(matches: DataFrame, of: DataFrame) -> DataFrame:
        """What the payers of ``of`` would choose, given who holds what."""
        reach = nameless.join(of.select("list_id").distinct(), "list_id", "left_semi")
        taken = reach.join(matches.select("right_id", "left_id"), "right_id").select(
            "list_id", "left_id", F.lit(1).cast("long").alias("one"), F.col("right_id").cast("decimal(38,0)").alias("id"),
            F.lit(None).cast("long").alias("n"), F.lit(None).cast("decimal(38,0)").alias("ids"))
        rows = taken.unionByName(of.select(
            "list_id", "left_id", F.lit(0).cast("long").alias("one"), F.lit(0).cast("decimal(38,0)").alias("id"), "n", "ids"))
        seen = running(rows, ["list_id"], "left_id", {"used": F.col("one"), "used_ids": F.col("id")})
        return seen.where((F.col("n").isNotNull()) & (F.col("n") - F.col("used") == 1)).select(
            "left_id", (F.col("ids") - F.col("used_ids")).cast("long").alias("right_id"))

    choice = cut(asks.where("n = 1").select("left_id", F.col("ids").cast("long").alias("right_id")), "choice")
    matches = cut(match(choice), "receipt-matches")
    if trace is not None:
        trace.append(entries.count())
    asked = asks
    while True:
        again = choices(matches, asked)
        if asked is not asks:
            again = choice.join(asked.select("left_id"), "left_id", "left_anti").unionByName(again)
        again = cut(again, "choice")
        changed = cut(again.exceptAll(choice).unionByName(choice.exceptAll(again)).select("left_id").distinct(), "changed")
        if changed.isEmpty():
            return matches
        # groups joined by what was chosen before as well as by what is chosen now
        before, before_lists = _tier_two(choice.select("left_id", "right_id"))
        now, now_lists = _tier_two(again)
        graph, graph_lists = left_lists.unionByName(before).unionByName(now), lists.unionByName(before_lists).unionByName(now_lists)
        touched = cut(_touched(changed, graph.select("left_id", "list_id").distinct(), graph_lists.distinct()), "touched")
        redone = cut(match(again, touched), "receipt-matches")
        old = matches.join(touched, "left_id", "left_semi")
        moved = redone.select("right_id", "left_id").exceptAll(old.select("right_id", "left_id")).unionByName(
            old.select("right_id", "left_id").exceptAll(redone.select("right_id", "left_id"))).select("right_id").distinct()
        cells = nameless.join(moved, "right_id", "left_semi").select("list_id").distinct()
        asked = cut(asks.join(cells, "list_id", "left_semi"), "asks")
        matches = cut(matches.join(touched, "left_id", "left_anti").unionByName(redone), "receipt-matches")
        choice = again
        if trace is not None:
            trace.append(touched.count())


def receipt_candidates(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Per receipt: invoices in reach with a matching name, nameless ones, and any (payers without a name)."""
    left_lists, lists, nameless = receipt_lists(entries, docs)
    sizes = lists.groupBy("list_id").agg(F.count("*").alias("n"))
    per = left_lists.join(sizes, "list_id").groupBy("left_id").agg(
        F.coalesce(F.sum(F.when(F.col("tier") < 2, F.col("n"))), F.lit(0)).alias("named"),
        F.coalesce(F.sum(F.when(F.col("tier") >= 10, F.col("n"))), F.lit(0)).alias("any_invoice"),
    )
    bare = nameless.groupBy("list_id").agg(F.count("*").alias("nameless"))
    asks = entries.where("client IS NOT NULL").select("left_id", _key("=z", "cents", "day").alias("list_id")).join(bare, "list_id")
    return per.join(asks.select("left_id", "nameless"), "left_id", "full_outer").select(
        F.col("left_id").alias("entry_id"), F.coalesce("named", F.lit(0)).alias("named"),
        F.coalesce("nameless", F.lit(0)).alias("nameless"), F.coalesce("any_invoice", F.lit(0)).alias("any_invoice"),
    )


def receipt_attachments(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Up to two rows per match: the PDF (once over all matches) and the XML."""
    score = F.lit(None).cast("double")
    for tier, value in RECEIPT_SCORES.items():
        score = F.when(F.col("tier") == tier, F.lit(value)).otherwise(score)
    bare = F.when(F.col("doc_model") == "65", 0.75).otherwise(0.7) + F.when(F.col("pdf_path").isNotNull(), 0.05).otherwise(0.0)
    m = matches.join(docs, "right_id").withColumn("entry_id", F.col("left_id")).withColumn(
        "score", F.round(F.when(F.col("tier") == 2, bare).otherwise(score), 2))
    first_use = m.where("pdf_path IS NOT NULL").groupBy("pdf_path").agg(F.min_by("entry_id", F.struct("entry_id", "right_id")).alias("_first"))
    pdf = m.join(first_use, "pdf_path").where("entry_id = _first").select(*_attachment(
        "receipts", F.col("pdf_path"), F.concat(F.lit(DANFE), fn.base_name("pdf_path")), F.lit("pdf"), F.col("score"), 0.9))
    xml = m.where("xml_path IS NOT NULL").select(*_attachment(
        "receipts", F.col("xml_path"), F.concat(F.lit(XML), fn.base_name("xml_path")), F.lit("xml"), F.col("score"), 0.9))
    return pdf.unionByName(xml)


# --- suppliers ------------------------------------------------------------

def supplier_payments(ledger: DataFrame, attached: DataFrame | None = None, vendors: list[str] = ()) -> DataFrame:
    """Outgoing supplier payments with a supplier name and no invoice attached yet."""
    text = F.concat_ws(" ", "description", "counterparty")
    wanted = F.col("category").ilike("%fornecedor%") | matches_any(text, list(vendors))
    out = with_flow(ledger).where(F.col("outflow") & wanted).select(
        "entry_id", cents("amount").alias("cents"), day_number("entry_date").alias("day"),
        normalize_name(supplier_name("description", "counterparty")).alias("sname"),
    ).where(F.length("sname") >= 3)
    if attached is None:
        return out
    done = attached.where(F.col("file_name").rlike("(?i)DANFE|NF entrada|XML NF")).select("entry_id")
    return out.join(done, "entry_id", "left_anti")


def supplier_invoices(payments: DataFrame, fiscal: DataFrame) -> DataFrame:
    """First invoice (by id) in reach whose name goes with the supplier's; invoices may be reused."""
    docs = fiscal.select(
        "fiscal_id", cents("total_value").alias("r_cents"), day_number("issue_date").alias("r_day"),
        normalize_name("counterparty_name").alias("dname"),
    ).where("dname <> '' AND r_cents IS NOT NULL AND r_day IS NOT NULL")
    docs = cut(docs.groupBy("r_cents", "r_day", "dname").agg(F.min("fiscal_id").alias("fiscal_id")), "supplier-docs")
    payments = cut(payments, "payments")
    classes = payments.select("cents", "day", "sname").distinct()
    pairs = containment(classes.select("sname"), "sname", docs.select("dname"), "dname")
    near = docs.join(pairs, "dname").withColumn("_c", blocks(F.col("r_cents"), LINK_CENTS)).withColumn("_b", blocks(F.col("r_day"), SUPPLIER_DAYS))
    keyed = classes.withColumn("_c", block("cents", LINK_CENTS)).withColumn("_b", block("day", SUPPLIER_DAYS))
    first = keyed.join(many(near), ["sname", "_c", "_b"]).where(
        within("cents", "r_cents", LINK_CENTS) & within("day", "r_day", SUPPLIER_DAYS)).groupBy("cents", "day", "sname").agg(F.min("fiscal_id").alias("fiscal_id"))
    return payments.join(first, ["cents", "day", "sname"]).select("entry_id", "fiscal_id")


def first_named_file(names: DataFrame, name: str, files: DataFrame, by_path: bool = False, prefix: bool = False) -> DataFrame:
    """Per distinct name the first file (by id) whose name, or path, goes with it: ``name, file_id``."""
    texts = [normalize_name("file_name")] + ([normalize_name("path")] if by_path else [])
    keyed = files.select("file_id", F.explode(F.array_distinct(F.array(*texts))).alias("_f")).where("_f <> ''")
    keyed = cut(keyed.groupBy("_f").agg(F.min("file_id").alias("file_id")), "file-names")
    names = cut(names.select(name).distinct(), "names")
    # the files that hold a name may be very many; the file names inside one name can't be
    inside = holds(names, name, keyed, "_f").join(keyed, "_f").select(name, "file_id")
    hits = first_holding(names, name, keyed, "_f", "file_id").unionByName(inside)
    if prefix:
        by_prefix = keyed.groupBy(F.left("_f", F.lit(6)).alias("_p")).agg(F.min("file_id").alias("file_id"))
        own = names.select(name).where(F.col(name) != "").distinct().withColumn("_p", F.left(name, F.lit(6)))
        hits = hits.unionByName(own.join(by_prefix, "_p").select(name, "file_id"))
    return hits.groupBy(name).agg(F.min("file_id").alias("file_id"))


def inbound_pdfs(files: DataFrame) -> DataFrame:
    return files.where((F.col("ext") == ".pdf") & F.col("path").rlike(INBOUND_FOLDER))


def slip_files(files: DataFrame) -> DataFrame:
    return files.where((F.col("kind") == "comprovante") & (F.col("ext") == ".pdf"))


def supplier_attachments(
    ledger: DataFrame, fiscal: DataFrame, pdfs: DataFrame, files: DataFrame, attached: DataFrame | None = None, vendors: list[str] = ()
) -> DataFrame:
    """Invoice (PDF and XML), else an inbound PDF by name; and the payment slip by name."""
    pay = cut(supplier_payments(ledger, attached, vendors), "payments")
    inv = cut(
        supplier_invoices(pay, fiscal)
        .join(fiscal.select("fiscal_id", "xml_path"), "fiscal_id").join(pdfs.select("fiscal_id", "pdf_path"), "fiscal_id", "left"),
        "supplier-invoices",
    )
    pdf_rows = inv.where("pdf_path IS NOT NULL").select(*_attachment(
        "suppliers", F.col("pdf_path"), F.concat(F.lit(INBOUND_PDF), fn.base_name("pdf_path")), F.lit("pdf"), F.lit(0.95), 0.9))
    xml_rows = inv.where("xml_path IS NOT NULL").select(*_attachment(
        "suppliers", F.col("xml_path"), F.concat(F.lit(INBOUND_XML), fn.base_name("xml_path")), F.lit("xml"), F.lit(0.95), 0.9))
    names = pay.select("sname").distinct()
    with_files = inv.where("pdf_path IS NOT NULL OR xml_path IS NOT NULL").select("entry_id")
    fallback = pay.join(with_files, "entry_id", "left_anti").join(first_named_file(names, "sname", inbound_pdfs(files)), "sname")
    slips = pay.join(first_named_file(names, "sname", slip_files(files), by_path=True), "sname")
    slips = slips.join(fallback.select("entry_id", "file_id"), ["entry_id", "file_id"], "left_anti")
    info = files.select("file_id", "path", "file_name", "size")

    def rows(df: DataFrame, label: str, score: float) -> DataFrame:
        return df.join(info, "file_id").select(*_attachment(
            "suppliers", F.col("path"), F.concat(F.lit(label), F.col("file_name")), F.lit("pdf"), F.lit(score), 0.9, F.col("size")))

    return pdf_rows.unionByName(xml_rows).unionByName(rows(fallback, INBOUND, 0.85)).unionByName(rows(slips, SLIP, 0.9))


# --- payroll deductions ----------------------------------------------------

def deduction_attachments(ledger: DataFrame, files: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    """Slip for payroll-deduction entries that have nothing attached; slips may be reused."""
    who = F.coalesce(F.nullif("counterparty", F.lit("")), F.col("description"))
    entries = ledger.where(F.col("category").ilike("%pensão alimentícia%")).select("entry_id", normalize_name(who).alias("name"))
    if attached is not None:
        entries = entries.join(attached.select("entry_id"), "entry_id", "left_anti")
    entries = cut(entries, "deductions")
    first = first_named_file(entries.select("name"), "name", slip_files(files), by_path=True, prefix=True)
    return entries.join(first, "name").join(files.select("file_id", "path", "file_name", "size"), "file_id").select(*_attachment(
        "deductions", F.col("path"), F.concat(F.lit(SLIP), F.col("file_name")), F.lit("pdf"), F.lit(1.0), 0.9, F.col("size")))


# --- any entry against any file ---------------------------------------------

# Score per tier. A file of the same bank account scores 0.05 more.
FILE_SCORES = {0: 1.05, 1: 1.0, 2: 0.95, 3: 0.9, 4: 0.85, 5: 0.8, 6: 0.75}


def attachable(files: DataFrame) -> DataFrame:
    slip, transfer = fn.slip_meta("file_name"), fn.transfer_meta("file_name")
    named = files.where(F.col("kind").isin(*fn.ATTACHABLE_KINDS) & ~F.col("file_name").endswith(".zip")).select(
        F.col("file_id").alias("right_id"), F.col("bank_account_id").alias("bank"), "file_name")
    # each step on its own: together they are too long for one generated method
    parsed = once(once(named, _slip=slip), _transfer=transfer)
    parsed = once(parsed, cents=cents(F.col("_slip.amount")), day=day_number(F.col("_slip.date")), iso=day_number(F.col("_transfer.date")))
    parsed = once(parsed, iname=normalize_name(F.col("_transfer.counterparty")))
    return once(parsed, fname=normalize_name("file_name")).select("right_id", "bank", "cents", "day", "iso", "iname", "fname")


def file_entries(ledger: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    """Entries that do not hold an invoice yet."""
    who = F.coalesce(F.nullif("counterparty", F.lit("")), F.col("description"))
    out = ledger.select(
        F.col("entry_id").alias("left_id"), cents("amount").alias("cents"), day_number("entry_date").alias("day"),
        F.col("bank_account_id").alias("bank"), normalize_name(who).alias("who"),
        F.array_remove(F.array_distinct(F.array(normalize_name("counterparty"), normalize_name("description"))), "").alias("names"),
    )
    if attached is None:
        return out
    done = attached.where(F.col("file_name").rlike("(?i)DANFE|XML NF")).select(F.col("entry_id").alias("left_id"))
    return out.join(done, "left_id", "left_anti")


def file_lists(entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference lists of entries over files.

    1.0 same date and value; 0.9 value within two days; 0.75 ISO date within
    two days and the payer's name (a name that fails ends the search); 0.8
    value and name. Plus 0.05 for the same bank account.
    """
    entries, files = cut(entries, "entries"), cut(files, "files")
    slips = files.where("cents IS NOT NULL AND day IS NOT NULL").select("right_id", "cents", "day", "bank")
    near = cell_lists(entries.select("cents", "day").distinct(), slips, LINK_CENTS, FILE_DAYS)
    kind = F.when(F.col("day") == F.col("r_day"), "s").otherwise("w")
    near = cut(near.select("cents", "day", "r_day", "bank", "right_id"), "file-values")
    both = F.array(_key(kind, "cents", "day"), F.when(F.col("bank").isNotNull(), _key(kind, "cents", "day", "bank")))
    by_value = near.select(F.explode(both).alias("list_id"), "right_id").where("list_id IS NOT NULL")

    # Value and name: lists per (cents, name) and per (cents, first six letters).
    named_slips = files.where("cents > 0").select("right_id", "bank", "fname", "iso", F.col("cents").alias("r_cents"))
    named = entries.select("cents", "day", F.explode("names").alias("name")).distinct()
    pairs = containment(named.select("name"), "name", named_slips.select("fname"), "fname")
    contained = named_slips.join(pairs, "fname").withColumn("k", F.concat(F.lit("n:"), F.col("name")))
    prefixed = named_slips.withColumn("k", F.concat(F.lit("p:"), F.left("fname", F.lit(6))))
    keyed = contained.select("right_id", "bank", "iso", "r_cents", "k").unionByName(prefixed.select("right_id", "bank", "iso", "r_cents", "k"))
    keyed = keyed.withColumn("_c", blocks(F.col("r_cents"), LINK_CENTS))
    wanted = named.select("cents", "day", F.explode(_name_keys("name")).alias("k")).distinct().withColumn("_c", block("cents", LINK_CENTS))
    near_amount = within("cents", "r_cents", LINK_CENTS)
    free = many(keyed.where("iso IS NULL")).join(wanted.select("_c", "cents", "k").distinct(), ["_c", "k"]).where(near_amount).select(
        "cents", F.lit(None).cast("int").alias("day"), "k", "bank", "right_id")
    # A file whose name also has an ISO date is out of reach near that date.
    dated = many(keyed.where("iso IS NOT NULL")).join(wanted, ["_c", "k"]).where(near_amount & ~within("day", "iso", FILE_DAYS)).select(
        "cents", "day", "k", "bank", "right_id")
    named_files = cut(free.unionByName(dated), "file-names")
    by_name = named_files.select(
        F.when(F.col("day").isNull(), _key("=v", "cents", "k")).otherwise(_key("=vd", "cents", "day", "k")).alias("base"), "bank", "right_id")

    # ISO date and payer name: lists per (day, name) and per (day, first six letters).
    iso = files.where("iso IS NOT NULL AND iname <> ''").select("right_id", "bank", "iso", "iname")
    payers = entries.where("who <> ''").select("day", "who").distinct()
    who_pairs = containment(payers.select("who"), "who", iso.select("iname"), "iname")
    iso_keys = iso.join(who_pairs, "iname").select("right_id", "bank", "iso", F.concat(F.lit("n:"), F.col("who")).alias("k")).unionByName(
        iso.select("right_id", "bank", "iso", F.concat(F.lit("p:"), F.left("iname", F.lit(6))).alias("k")))
    iso_keys = iso_keys.withColumn("_b", blocks(F.col("iso"), FILE_DAYS))
    payer_keys = payers.select("day", F.explode(_name_keys("who")).alias("k")).distinct().withColumn("_b", block("day", FILE_DAYS))
    paid_files = cut(many(iso_keys).join(payer_keys, ["_b", "k"]).where(within("day", "iso", FILE_DAYS)).select("day", "k", "bank", "right_id"), "file-payers")
    by_date = paid_files.select(_key("=i", "day", "k").alias("base"), "bank", "right_id")

    with_bank = F.array(F.col("base"), F.when(F.col("bank").isNotNull(), _key("base", "bank")))
    others = by_name.unionByName(by_date).select(F.explode(with_bank).alias("list_id"), "right_id").where("list_id IS NOT NULL")

    def pick(tier: int, key: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), key.alias("list_id"))

    def found(rows: DataFrame, cells: DataFrame, *on: str) -> DataFrame:
        """Rows with a file in their cell, so that no keys are made that no list has."""
        return rows.join(many(cells.select(*on).distinct()), list(on), "left_semi")

    has_bank = F.col("bank").isNotNull()
    value_tiers = F.array(
        pick(0, F.when(has_bank, _key("=s", "cents", "day", "bank"))), pick(1, _key("=s", "cents", "day")),
        pick(2, F.when(has_bank, _key("=w", "cents", "day", "bank"))), pick(3, _key("=w", "cents", "day")),
    )
    a = found(entries.select("left_id", "cents", "day", "bank"), near, "cents", "day").select("left_id", near_value("cents").alias("place"), F.inline(value_tiers))
    by_k = entries.select("left_id", "cents", "day", "bank", F.explode(F.flatten(F.transform("names", _name_keys))).alias("k")).distinct()
    name_tiers = F.array(
        pick(4, F.when(has_bank, _key("=v", "cents", "k", "bank"))), pick(5, _key("=v", "cents", "k")),
        pick(4, F.when(has_bank, _key("=vd", "cents", "day", "k", "bank"))), pick(5, _key("=vd", "cents", "day", "k")),
    )
    b = found(by_k, named_files, "cents", "k").select("left_id", near_value("cents").alias("place"), F.inline(name_tiers))
    date_tiers = F.array(pick(5, F.when(has_bank, _key("=i", "day", "k", "bank"))), pick(6, _key("=i", "day", "k")))
    c = entries.where("who <> ''").select("left_id", "cents", "day", "bank", F.explode(_name_keys("who")).alias("k"))
    c = found(c, paid_files, "day", "k").select("left_id", near_value("cents").alias("place"), F.inline(date_tiers))
    left_lists = a.unionByName(b).unionByName(c).where("list_id IS NOT NULL")
    return left_lists, by_value.unionByName(others)


def _name_keys(name) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.array(F.concat(F.lit("n:"), c), F.concat(F.lit("p:"), F.left(c, F.lit(6))))


def file_candidates(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Per entry the best score any file in reach would give it, before anyone takes one."""
    left_lists, lists = file_lists(entries, files)
    heads = left_lists.join(lists.groupBy("list_id").agg(F.min("right_id").alias("right_id")), "list_id")
    best = heads.groupBy("left_id").agg(F.min(F.struct("tier", "right_id")).alias("b"))
    return best.select(F.col("left_id").alias("entry_id"), F.col("b.right_id").alias("file_id"), tier_score("b.tier", FILE_SCORES).alias("score"))


def tier_score(tier: str, scores: dict[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for t, value in scores.items():
        out = F.when(F.col(tier) == t, F.lit(value)).otherwise(out)
    return out


def match_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    return greedy_assign(*file_lists(entries, files))


def file_attachments(ledger: DataFrame, files: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    matches = match_files(file_entries(ledger, attached), attachable(files))
    return matches.withColumn("entry_id", F.col("left_id")).join(files.withColumnRenamed("file_id", "right_id"), "right_id").select(*_attachment(
        "general", F.col("path"), F.col("file_name"), F.translate("ext", ".", ""), tier_score("tier", FILE_SCORES), 0.95, F.col("size")))


# --- fuel receipts ----------------------------------------------------------

FUEL_SCORES = {0: 0.98, 1: 0.85, 2: 0.7}  # fixed values: by minutes apart: up to 30, up to 120, else
ONLY_ONE, NEXT_DAY = 0.95, 0.6  # fixed values
MINUTE_LEVELS = 7  # blocks of up to 128 minutes
FUEL_CHUNK, FUEL_SPARE = 50_000, 1024  # receipts of a day that one task matches; those of a larger day go in turn; entries at hand of a block


def fuel_entries(ledger: DataFrame) -> DataFrame:
    return ledger.where(fuel_linkable()).select(
        "entry_id", "entry_date", day_number("entry_date").alias("day"), "amount", "category", "debit_account",
        "description", "counterparty", "bank_account_id",
        F.coalesce(minutes_in_text("counterparty"), minutes_in_text("description")).alias("minute"),
    )


def _day_plan(days: pd.DataFrame) -> pd.DataFrame:
    """Counts only, for one run of consecutive days: one row per calendar day.

    ``avail`` entries are free when the day's receipts come up. Receipts beyond
    that find nothing on the day; the first of them takes the neighbour day's
    entry if exactly one is free there (``side`` -1 before, 1 after, else 0).
    """
    days = days.sort_values("day")
    entries = dict(zip(days["day"], days["entries"]))
    taken: set[int] = set()
    rows, free_before = [], {}
    for day, receipts, n in zip(days["day"], days["receipts"], days["entries"]):
        avail = 0 if day in taken else n
        free_before[day] = avail - min(receipts, avail)
        side = 0
        if receipts > avail:
            before, after = free_before.get(day - 1, 0), entries.get(day + 1, 0)
            if before + after == 1:
                side = 1 if after else -1
                if after:
                    taken.add(day + 1)
        rows.append((day, avail, side, day in taken))
    return pd.DataFrame(rows, columns=["day", "avail", "side", "taken"])


def fuel_day_plan(receipts: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per day: grouped counts first, so the sequential part sees calendar days, never rows."""
    m = receipts.groupBy("day").agg(F.count("*").alias("receipts"))
    n = entries.groupBy("day").agg(F.count("*").alias("entries"))
    days = m.join(n, "day", "full_outer").na.fill(0).select("day", "receipts", "entries")
    w = W.orderBy("day")  # calendar days: tens of thousands of rows at most
    starts = (F.col("day") - F.coalesce(F.lag("day").over(w), F.col("day")) > 1).cast("int")
    runs = days.withColumn("run", F.sum(starts).over(w))
    return runs.groupBy("run").applyInPandas(_day_plan, "day int, avail long, side int, taken boolean")


def _minute_blocks(first: Column, last: Column) -> list[tuple[Column, int, Column]]:
    """``(whether, level, block)``: the fewest blocks of 2^level minutes that make up ``first`` to ``last``, two of a level at most."""
    out = []
    for level in range(MINUTE_LEVELS + 1):
        lo, hi = F.ceil(first / 2**level), F.floor((last + 1) / 2**level) - 1
        out += [((lo <= hi) & (lo % 2 == 1), level, lo), ((lo <= hi) & (hi % 2 == 0), level, hi)]
    return out


def fuel_minute_lists(receipts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of the receipt's day: within 30 minutes, within 120, any.

    Lists belong to blocks of 1, 2, 4 ... minutes of a day, so an entry is on ten lists at
    most and a receipt names the few blocks that make up its stretches of time.
    """
    timed = entries.where("minute IS NOT NULL").select("entry_id", "day", "minute", F.explode(F.sequence(F.lit(0), F.lit(MINUTE_LEVELS))).alias("level"))
    block = F.floor(F.col("minute") / F.pow(F.lit(2), F.col("level")))
    by_minute = timed.select(_key("=m", "day", "level", block).alias("list_id"), F.col("entry_id").alias("right_id"))
    by_day = entries.select(_key("=z", "day").alias("list_id"), F.col("entry_id").alias("right_id"))
    tiers = [F.struct(F.lit(2).alias("tier"), _key("=z", "day").alias("list_id"))]
    for tier, reach in ((0, 30), (1, 120)):
        first, last = F.greatest(F.col("minute") - reach, F.lit(0)), F.col("minute") + reach
        tiers += [
            F.when(there, F.struct(F.lit(tier).alias("tier"), _key("=m", "day", f"={level}", at).alias("list_id")))
            for there, level, at in _minute_blocks(first, last)]
    left = receipts.select(
        F.col("doc_id").alias("left_id"), F.col("day").cast("string").alias("place"), F.inline(F.filter(F.array(*tiers), lambda t: t.isNotNull())))
    return left, by_minute.unionByName(by_day)


def match_fuel(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """Receipts in date order, entries exclusive: ``doc_id, entry_id, score``.

    As many receipts of a day as it has free entries are matched on the day,
    by time of day; the one that finds a single entry left scores 0.95.
    """
    receipts = cut(
        documents.where("doc_date IS NOT NULL").select("doc_id", day_number("doc_date").alias("day"), minutes_in_text("doc_time").alias("minute")),
        "receipts",
    )
    entries = cut(entries.select("entry_id", "day", "minute"), "fuel-entries")
    plan = cut(fuel_day_plan(receipts, entries), "fuel-days")
    turn = cut(ranked(receipts, ["day"], "doc_id", "turn").join(plan, "day"), "fuel-turns")
    free = entries.join(plan.where("NOT taken").select("day"), "day")
    same_day = greedy_assign(*fuel_minute_lists(turn.where("turn <= avail"), free), chunk=FUEL_CHUNK, spare=FUEL_SPARE).select(
        F.col("left_id").alias("doc_id"), F.col("right_id").alias("entry_id"), "tier")
    same_day = cut(same_day, "fuel-same-day")
    scored = same_day.join(turn.select("doc_id", (F.col("turn") == F.col("avail")).alias("last")), "doc_id").select(
        "doc_id", "entry_id", F.when(F.col("last"), ONLY_ONE).otherwise(tier_score("tier", FUEL_SCORES)).alias("score"))
    surplus = turn.where("side <> 0 AND turn = avail + 1").select("doc_id", (F.col("day") + F.col("side")).alias("day"))
    # Only days a surplus receipt points at, where exactly one entry is free.
    left_over = entries.join(surplus, "day").join(same_day.select("entry_id"), "entry_id", "left_anti")
    near = left_over.select("doc_id", "entry_id", F.lit(NEXT_DAY).alias("score"))
    return scored.unionByName(near)


def fuel_records(documents: DataFrame, entries: DataFrame, matches: DataFrame) -> DataFrame:
    """One record per receipt with its entry's figures, or defaults where none was found."""
    e = entries.select("entry_id", "amount", station_name("description", "counterparty").alias("station"), "bank_account_id", "category", "debit_account")
    linked = matches.join(e, "entry_id")
    return documents.join(linked, "doc_id", "left").select(
        "doc_id", "file_name", "doc_date", "doc_time", "amount", "station", "bank_account_id", "entry_id",
        F.coalesce("category", F.lit("Despesa combustível")).alias("category"),
        F.coalesce("debit_account", F.lit(FUEL_DEFAULT_ACCOUNT)).alias("debit_account"),
        F.when(F.col("entry_id").isNotNull(), LINKED).otherwise(UNLINKED).alias("status"),
        "score",
    )


def fuel_attachments(documents: DataFrame, matches: DataFrame, path: str = "file_name") -> DataFrame:
    return matches.join(documents, "doc_id").select(*_attachment(
        "fuel", F.col(path), F.concat(F.lit(FUEL), F.col("file_name")), F.translate("ext", ".", ""), F.col("score"), 0.9, F.col("size")))


# --- all stages -------------------------------------------------------------

def link_all(
    ledger: DataFrame, fiscal: DataFrame, files: DataFrame, fuel_documents: DataFrame | None = None,
    own: list[str] = (), partners: list[str] = (), vendors: list[str] = (),
) -> DataFrame:
    """Receipts, suppliers, deductions, any file, fuel. Each stage sees what earlier ones attached.

    Every stage reads the inputs, most of them several times, so these are written once.
    """
    ledger, fiscal, files = cut(ledger, "ledger"), cut(fiscal, "fiscal"), cut(files, "files")
    pdfs = cut(invoice_pdfs(fiscal, files), "invoice-pdfs")
    docs = cut(receipt_invoices(fiscal, pdfs), "receipt-invoices")
    attached = cut(receipt_attachments(match_receipts(cut(client_receipts(ledger, own, partners), "client-receipts"), docs), docs), "attached")
    attached = attached.unionByName(cut(supplier_attachments(ledger, fiscal, pdfs, files, attached, vendors), "attached"))
    attached = attached.unionByName(cut(deduction_attachments(ledger, files, attached), "attached"))
    attached = attached.unionByName(cut(file_attachments(ledger, files, attached), "attached"))
    if fuel_documents is not None:
        fuel_documents = cut(fuel_documents, "fuel-documents")
        fuel = match_fuel(fuel_documents, fuel_entries(ledger))
        attached = attached.unionByName(cut(fuel_attachments(fuel_documents, fuel), "attached"))
    return attached
