"""Scalar functions, layouts, rules and checks on literal rows."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Window as W, functions as F

from tallyweave.functions import accounts as acc, dates, filenames as fn, money, text
from tallyweave.operators import classify, links, matching, names, overlay, ranking
from tallyweave.plans import export, monthly
from tallyweave.sources import invoices, statements


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def D(x):
    return Decimal(x).quantize(Decimal("0.01"))


@pytest.mark.parametrize("raw,want", [("1.234,56", "1234.56"), ("-105,00", "-105"), ("", "0"), ("1234.56", "123456"), ("abc", None), ("105,00.", "105")])
def test_money(spark, raw, want):
    assert value(spark, money.parse_money(F.lit(raw))) == (None if want is None else D(want))


@pytest.mark.parametrize("raw,want", [("05/06/2026", date(2026, 6, 5)), ("05.06.2026 x", date(2026, 6, 5)), ("2026-06-05", None), ("31/02/2026", None)])
def test_date(spark, raw, want):
    assert value(spark, dates.parse_br_date(F.lit(raw))) == want


def test_names(spark):
    assert value(spark, text.normalize_name(F.lit("João Çã-1"))) == "JOAOCA1"


def test_slip_and_minutes(spark):
    slip = value(spark, fn.slip_meta(F.lit("1 - 01062026 - Pagamento - 105,00.pdf")))
    assert (slip.date, slip.type, slip.amount, slip.is_payment) == (date(2026, 6, 1), "Pagamento", D(105), True)
    assert value(spark, fn.slip_meta(F.lit("1 - 01062026 - Paga-mento - 105,00.pdf"))) is None
    assert value(spark, dates.minutes_in_text(F.lit("12:30 x"))) == 750
    assert value(spark, dates.minutes_in_text(F.lit("12 30"))) == 750
    assert value(spark, dates.minutes_gap(dates.minutes_in_text(F.lit("x")), F.lit(10))) == 9999


def test_client_name(spark):
    line = "Pix - Recebido 01/06 10:20 12345678901 JANE ROE 02/06"
    no = F.lit(False)
    assert value(spark, text.client_name(F.lit(line), F.lit(None), no, no)) == "JANE ROE"
    assert value(spark, text.client_name(F.lit(line), F.lit(None), F.lit(True), no)) is None


def test_file_kinds(spark):
    want = {
        "s\\XML 06-2026\\a.pdf": "danfe", "s/EXTRATO junho.csv": "extrato", "s/a.xml": "xml_nfe", "s/COMBUSTÍVEL/a.pdf": "combustivel",
        "s/1 - 01062026 x.pdf": "comprovante", "s/NOTA FISCAL/a.pdf": "nota_fiscal", "s/fatura-inter.pdf": "fatura_cartao",
        "s/boleto.pdf": "boleto", "s/a.jpg": "anexo", "s/a.zip": "outro",
    }
    rows = spark.createDataFrame([(k,) for k in want], "path string").select("path", fn.file_kind("path").alias("k")).collect()
    assert {r.path: r.k for r in rows} == want


def test_rules_order_case_and_zero(spark):
    rows = classify.standard_rule_rows(partners=[(r"JOHN\s*DOE", "Partner", "2.02")], own_company=["ACME"])
    tx = spark.createDataFrame(
        [(1, "transferência autom. recebida 8840", None, D(5)), (2, "PIX RECEBIDO JOHN DOE", None, D(5)), (3, "IMPOSTO", None, D(-5)),
         (4, "Pix - Enviado X", None, D(-5)), (5, "PIX ENVIADO X", None, D(0)), (6, "JUROS SALDO DEVEDOR", None, D(-1)), (7, "PIX RECEBIDO ACME", None, D(1))],
        "tx_id long, description string, counterparty string, amount decimal(18,2)")
    got = {r.tx_id: r for r in classify.post_double_entry(classify.classify(tx, rows).withColumn("bank_coa", F.lit("BANK"))).collect()}
    assert got[1].category.startswith("Recebimento cartão") and got[2].category == "Partner" and got[7].counter_account == "1.01.01.01.02.0002"
    assert got[3].category == "Despesa combustível"  # POSTO inside a word
    assert got[4].category == classify.UNCLASSIFIED and got[5].status == "manual_review"
    assert (got[5].debit_account, got[5].credit_account) == ("9.9.9.99", "BANK")
    assert got[6].category == "Juros bancários / mora"
    words = {r.tx_id: r.category for r in classify.classify(tx, rows, whole_words=True).collect()}
    assert words[3] == classify.UNCLASSIFIED
    table = {r.tx_id: r.category for r in classify.classify_by_table(tx, classify.rules_frame(spark, rows)).collect()}
    assert table == {k: r.category for k, r in got.items()}


def test_layouts(spark):
    def one(line, layout, form=None):
        df = spark.createDataFrame([(line,)], "value string")
        return statements.parse_lines(df, F.lit(layout), layouts={**statements.LAYOUTS, **({layout: form} if form else {})}).first()

    p = one('05/06/2026,PIX,"ROE, JANE",123,"-1.234,56",0', "layout1")
    assert (p.counterparty, p.amount, p.reason) == ("ROE, JANE", D("-1234.56"), None)
    assert one("05/06/2026;PIX;10,00", "layout1_txt").amount == D(10)
    assert one("05/06/2026;SALDO DO DIA;10,00", "layout1_txt").reason == "skipped"
    assert one("05/06/2026;JUROS SALDO DEVEDOR;10,00", "layout1_txt").reason is None
    strict = statements.Layout("layout1", ";", statements.ANY_BALANCE)
    assert one("05/06/2026;JUROS SALDO DEVEDOR;10,00", "layout1_txt", strict).reason == "skipped"
    assert one("31/02/2026;PIX;10,00", "layout1_txt").reason == "bad_date"
    assert one("05/06/2026;PIX;x", "layout1_txt").reason == "bad_amount"
    p = one("1;2;;05.06.2026;;;;REF;;PIX;10,00;D;JANE", "layout2")
    assert (p.amount, p.external_ref, p.description) == (D(-10), "REF", "PIX JANE")
    assert one("1;2;;05.06.2026;;;;REF;;S A L D O;10,00;C;", "layout2").reason == "skipped"
    assert one('05/06/2026;"Cp :123-JANE ROE";-3,50;0', "layout3").counterparty == "JANE ROE"
    assert one('05/06/2026;a "b;c;1,00', "layout1_txt").description == "c"  # an unpaired quote: the separator before it stands inside
    assert one(None, "layout2").reason == "skipped" and one("x", None).reason == "no_layout"


def test_a_line_is_parsed_once(spark):
    """The plan splits and types a line once, also below a filter on the result."""
    df = spark.range(3).select(F.concat(F.lit("05/06/2026;x;"), F.col("id").cast("string")).alias("value"), F.element_at(F.array(F.lit("layout2"), F.lit("layout3")), (F.col("id") % 2 + 1).cast("int")).alias("l"))
    plan = statements.parse_lines(df, F.col("l")).where("reason IS NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3 and plan.count("regexp_extract_all(") <= 2  # one for each separator
    xml = spark.createDataFrame([("<NFe><infNFe><ide><nNF>00012345678901234567890</nNF></ide></infNFe></NFe>",), ("<bad",)], "xml string")
    got = invoices.parse_invoices(xml, "1")
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("from_xml") + got._jdf.queryExecution().optimizedPlan().toString().count("xmltostructs") <= 1
    assert [r.doc_number for r in got.collect()] == ["12345678901234567890"]


def test_copies_are_told_per_account_and_order(spark):
    rows = [("p1", "a", "fee", 0), ("p2", "b", "fee", 0), ("p3", "a", "fee", 0), ("q1", "a", "x", 0), ("q1", "a", "y", 1), ("q2", "a", "y", 0), ("q2", "a", "x", 1)]
    lines = spark.createDataFrame(rows, "path string, bank_account_id string, value string, line_no long")
    assert {r.path for r in statements.first_copies(statements.file_fingerprints(lines)).collect()} == {"p1", "p2", "q1", "q2"}


def test_money_in_and_out_by_sign(spark):
    """A payment whose debit side is its own bank's code still goes out; nothing moves for a zero amount."""
    rows = [(1, "x", "ACME LTDA", "fornecedor", "B", "B", D(5), D(-5)), (2, "x", "ACME LTDA", "fornecedor", "B", "2.01", D(0), D(0)), (3, "x", "JANE ROE", "cliente", "B", "9", D(5), D(5))]
    schema = "entry_id long, description string, counterparty string, category string, bank_coa string, debit_account string, amount decimal(18,2), signed_amount decimal(18,2)"
    led = spark.createDataFrame(rows, schema).withColumn("entry_date", F.lit("2026-06-05").cast("date"))
    assert [r.entry_id for r in links.supplier_payments(led).collect()] == [1]
    assert [r.left_id for r in links.client_receipts(led).collect()] == [3]
    assert {r.entry_id for r in links.supplier_payments(led.drop("signed_amount")).collect()} == {2}


def test_invoice_pdf_beside_backslash_paths(spark):
    key = "1" * 44
    fiscal = spark.createDataFrame([(1, rf"\\srv\docs\06\{key}.xml")], "fiscal_id long, xml_path string")
    files = spark.createDataFrame([(rf"\\srv\other\{key}.pdf", f"{key}.pdf"), (rf"\\srv\docs\06\{key}.pdf", f"{key}.pdf")], "path string, file_name string")
    got = links.invoice_pdfs(fiscal, files).collect()
    assert [(r.place, r.pdf_path.split("\\")[3]) for r in got] == [(1, "docs")]


def test_ranks_by_bucket_equal_plain_ranks(spark):
    df = spark.range(500).select((F.col("id") * 7 % 1009).alias("o"), (F.col("id") % 3).alias("k"))
    w = W.partitionBy("k").orderBy("o")
    a = sorted(ranking.ranked(df, ["k"], "o").select("k", "o", "pos").collect())
    assert a == sorted(df.select("k", "o", F.row_number().over(w).cast("long")).collect())
    a = sorted(ranking.running(df, ["k"], "o", {"s": F.col("o")}).select("k", "o", "s").collect())
    assert a == sorted(df.select("k", "o", F.coalesce(F.sum("o").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).collect())


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as NS

    from tallyweave import session

    bare = lambda master: NS(conf=NS(get=lambda k, d=None: None), sparkContext=NS(master=master, applicationId=f"x-{master}"))
    assert session.work_dir(bare("local[4]")).startswith("/") and session.work_dir(bare("local"))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.work_dir(bare(master))


def test_intermediate_tables_are_dropped(spark):
    import os

    from tallyweave import session

    def tables():
        return set(os.listdir(session.work_dir(spark)))

    session.drop_intermediate(spark)
    before = tables()
    for _ in range(2):
        left = spark.range(20).select(F.col("id").alias("left_id"), F.lit(0).alias("tier"), F.lit("a").alias("list_id"))
        right = spark.range(9).select(F.lit("a").alias("list_id"), F.col("id").alias("right_id"))
        assert matching.greedy_assign(left, right).count() == 9
        assert session.drop_intermediate(spark) > 5 and tables() == before


def test_rule_table_of_any_length(spark):
    n = 2 * classify.RULE_BLOCK + 7
    rules = spark.createDataFrame([(i, f"WORD{i}X", f"c{i}", "1", "operacional") for i in range(n)], "priority int, pattern string, category string, counter_account string, nature string")
    tx = spark.createDataFrame([(i, f"a WORD{n - 1 - i}X WORD{n - 1}X", None) for i in range(n)] + [(n, None, None)], "tx_id long, description string, counterparty string")
    got = {r.tx_id: r.category for r in classify.classify_by_table(tx, rules).collect()}
    assert got == {i: f"c{n - 1 - i}" for i in range(n)} | {n: classify.UNCLASSIFIED}


def test_matching_in_small_chunks(spark, monkeypatch):
    """Many chunks and a crowded place give what one chunk gives."""
    left = spark.range(90).select(F.col("id").alias("left_id"), F.lit("p").alias("place"), F.explode(F.array(
        F.struct(F.lit(0).alias("tier"), F.concat(F.lit("a"), (F.col("id") % 4).cast("string")).alias("list_id")),
        F.struct(F.lit(1).alias("tier"), F.concat(F.lit("b"), (F.col("id") % 3).cast("string")).alias("list_id")),
        F.struct(F.lit(1).alias("tier"), F.lit("c").alias("list_id")),
    )).alias("x")).select("left_id", "place", "x.*")
    right = spark.range(70).select(F.col("id").alias("right_id"), F.explode(F.array(
        F.concat(F.lit("a"), (F.col("id") % 9).cast("string")), F.concat(F.lit("b"), (F.col("id") % 5).cast("string")),
        F.when(F.col("id") % 2 == 0, "c").otherwise("d"))).alias("list_id")).distinct().select("list_id", "right_id")
    lists = {}
    for r in right.collect():
        lists.setdefault(r.list_id, []).append(r.right_id)
    used, want = set(), {}
    for i in range(90):
        for tier in ([f"a{i % 4}"], [f"b{i % 3}", "c"]):
            free = sorted(x for n in tier for x in lists.get(n, []) if x not in used)
            if free:
                used.add(free[0])
                want[i] = free[0]
                break
    for chunk, spare, block in ((1000, 128, 256), (11, 128, 256), (11, 0, 2), (1000, 1, 3)):
        monkeypatch.setattr(matching, "SPARE", spare)
        monkeypatch.setattr(matching, "BLOCK", block)
        trace = []
        assert {r.left_id: r.right_id for r in matching.greedy_assign(left, right, chunk=chunk, trace=trace).collect()} == want
        # a round writes its new proposals and used-up lists, and a frontier that falls to nothing
        assert trace[-1]["frontier"] == 0 and sum(t["log"] for t in trace[1:]) < trace[0]["log"] * len(trace)


def test_matching_writes_with_its_frontier(spark):
    """Settled rows are not written again: later rounds write no more than their frontier can move."""
    n = 3000
    left = spark.range(n).select(F.col("id").alias("left_id"), F.lit("p").alias("place"), F.explode(F.array(
        F.struct(F.lit(0).alias("tier"), F.concat(F.lit("a"), (F.col("id") % 500).cast("string")).alias("list_id")),
        F.struct(F.lit(1).alias("tier"), F.concat(F.lit("b"), (F.col("id") % 97).cast("string")).alias("list_id")))).alias("x")).select("left_id", "place", "x.*")
    right = spark.range(n).select(F.col("id").alias("right_id"), F.explode(F.array(
        F.concat(F.lit("a"), (F.col("id") * 7 % 510).cast("string")), F.concat(F.lit("b"), (F.col("id") % 97).cast("string")))).alias("list_id"))
    trace = []
    got = matching.greedy_assign(left, right.distinct(), chunk=300, trace=trace)
    assert got.select("right_id").distinct().count() == got.count() and len(trace) > 2
    assert all(b["log"] <= a["frontier"] * 300 for a, b in zip(trace, trace[1:], strict=False))
    assert all(b["log"] + b["frontier"] < 0.5 * trace[0]["log"] for b in trace[2:]) and trace[-1]["log"] < trace[1]["log"] < trace[0]["log"]


def test_matching_keeps_large_ids(spark):
    """Identifiers above 2^53 stay what they are."""
    top = (1 << 62) + 1
    left = spark.range(6).select((F.col("id") + top).alias("left_id"), F.lit(0).alias("tier"), F.lit("a").alias("list_id"))
    right = spark.range(4).select(F.lit("a").alias("list_id"), (F.col("id") * 2 + top).alias("right_id"))
    assert {(r.left_id - top, r.right_id - top) for r in matching.greedy_assign(left, right, chunk=2).collect()} == {(i, 2 * i) for i in range(4)}


def test_containment_equals_all_pairs(spark):
    a = ["ABCDEF", "CDEFGH", "AB", "X", "LOJAAZUL", "AZUL", "ZULX"]
    b = ["BCDE", "B", "AZUL", "LOJAAZULSA", "CDEFGHIJ", "Q"]
    got = {(r.a, r.b) for r in names.containment(spark.createDataFrame([(x,) for x in a], "a string"), "a", spark.createDataFrame([(x,) for x in b], "b string"), "b").collect()}
    assert got == {(x, y) for x in a for y in b if x in y or y in x}


def test_changes(spark):
    led = spark.createDataFrame([(1, "a", "b", "c", "manual_review")], "entry_id long, debit_account string, credit_account string, category string, status string")
    ch = spark.createDataFrame([(1, 1, "x", None, None, "matched"), (1, 2, None, "", "new", "pending")], "entry_id long, seq int, debit_account string, credit_account string, category string, status string")
    r = overlay.apply_changes(led, ch).first()
    assert (r.debit_account, r.credit_account, r.category, r.status) == ("x", "b", "new", "pending")


def test_not_in_follows_sql(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    full, empty = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([], "k int")
    with_null = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r.k for r in monthly.not_in(left, "k", full, "k").collect()] == [2]
    assert monthly.not_in(left, "k", with_null, "k").count() == 0
    assert monthly.not_in(left, "k", empty, "k").count() == 3


def test_export_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, *['a"b'] * 11)], "entry_id long, " + ", ".join(f"c{i} string" for i in range(11)))
    export.write_export(rows, str(tmp_path / "x"))
    body = "".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*")))
    assert body.startswith("\"﻿Data\"") and '"a""b";"a""b"' in body


def test_duplicate_landing_files(spark, tmp_path):
    """The second batch repeats a file's content under another name: its rows are not loaded again."""
    from tallyweave.streaming import landing

    banks = spark.createDataFrame([("acct-1", "B", "1.01")], "bank_account_id string, bank string, coa_code string")
    rules = classify.standard_rule_rows()
    src = tmp_path / "in" / "account=acct-1"
    src.mkdir(parents=True)
    run = lambda: landing.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), {"acct-1": "layout3"}, banks, rules).awaitTermination()
    (src / "a.csv").write_text("05/06/2026;PIX RECEBIDO;10,00;0\n06/06/2026;x;5,00;0\n31/02/2026;x;5,00;0\n")
    run()
    (src / "b.csv").write_text("05/06/2026;PIX RECEBIDO;10,00;0\n06/06/2026;x;5,00;0\n31/02/2026;x;5,00;0\n")
    (src / "c.csv").write_text("07/06/2026;y;1,00;0\n")
    run()
    assert spark.read.parquet(str(tmp_path / "out" / "ledger")).count() == 3
    assert len({r.entry_id for r in spark.read.parquet(str(tmp_path / "out" / "ledger")).collect()}) == 3
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()] == ["bad_date"]
    assert acc.CATCH_ALL == "9.9.9.99"
