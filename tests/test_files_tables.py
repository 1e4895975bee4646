"""Files and tables on disk: the landing stream's state, bundles and listings, month tables, merged reports."""

import shutil

import pytest

from tallyweave import queries, sample
from tallyweave.operators import classify
from tallyweave.sources import accounts, documents, invoices
from tallyweave.streaming import landing

SF = "/root/testdata/sf0.001"
ROWS = "05/06/2026;PIX RECEBIDO;10,00;0\n06/06/2026;x;5,00;0\n"


def _run(spark, base, prefixes=None, rules=None):
    banks = spark.createDataFrame([("acct-1", "B", "1.01")], "bank_account_id string, bank string, coa_code string")
    return landing.ingest(
        spark, f"{base}/in", f"{base}/out", f"{base}/cp", prefixes or {"acct-1": "layout3"}, banks, rules or classify.standard_rule_rows())


def test_copies_are_known_without_earlier_batches(spark, tmp_path):
    src = tmp_path / "in" / "account=acct-1"
    src.mkdir(parents=True)
    (src / "a.csv").write_text(ROWS)
    _run(spark, tmp_path).awaitTermination()
    first = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/ledger").collect()}
    for part in ("lines", "files", "seen"):  # what earlier batches wrote is not read again
        shutil.rmtree(tmp_path / "out" / part)
    (src / "b.csv").write_text(ROWS)
    (src / "c.csv").write_text("07/06/2026;y;1,00;0\n")
    _run(spark, tmp_path).awaitTermination()
    after = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/ledger").collect()}
    assert first < after and len(after) == 3
    _run(spark, tmp_path).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/ledger").collect()} == after


def test_batch_that_failed_runs_again(spark, tmp_path):
    src = tmp_path / "in" / "account=acct-1"
    src.mkdir(parents=True)
    (src / "a.csv").write_text(ROWS)
    with pytest.raises(Exception):
        _run(spark, tmp_path, rules=[("not a rule",)]).awaitTermination()
    _run(spark, tmp_path).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/ledger").collect()
    assert len(rows) == 2 and len({r.entry_id for r in rows}) == 2
    assert spark.read.parquet(f"{tmp_path}/out/files").count() == 1


def test_state_settings_do_not_stay(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in landing.STATE}
    (tmp_path / "in" / "account=acct-1").mkdir(parents=True)
    (tmp_path / "in" / "account=acct-1" / "a.csv").write_text(ROWS)
    _run(spark, tmp_path).awaitTermination()
    assert {k: spark.conf.get(k, None) for k in landing.STATE} == before


def test_month_tables_join_without_shuffle(spark):
    """Both scans get the months of the calendar, and the join on the bucketed key has no exchange of rows."""
    both = queries.month_tables_join(spark, lambda v: sample.view(spark, SF, v))[1]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")  # the calendar is below, the tables above
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("dynamicpruning") >= 2 and "Exchange hashpartitioning" not in plan
    months = {r.month for r in both.select("month").distinct().collect()}
    assert 0 < len(months) < 80


def test_literal_month_opens_one_folder(spark, tmp_path):
    from tallyweave.plans import monthly

    monthly.write_month(sample.view(spark, SF, "ledger"), f"{tmp_path}/m")
    one = monthly.read_month(spark, f"{tmp_path}/m", "1998-03")
    plan = one._jdf.queryExecution().executedPlan()
    assert "1998-03" in plan.toString().split("PartitionFilters:")[1].split("]")[0]
    assert {f.split("/")[-2] for f in [r[0] for r in one.select("_metadata.file_path").distinct().collect()]} == {"month=1998-03"}


def test_invoice_files(spark, tmp_path):
    good = "<?xml version='1.0'?>\n<nfeProc>\n<NFe><infNFe><ide><nNF>007</nNF><mod>55</mod></ide><dest><CNPJ>1</CNPJ><xNome>A &amp; B</xNome></dest></infNFe></NFe></nfeProc>"
    texts = {"a": good, "b": good.replace("</dest>", ""), "c": "<other/>", "d": "", "e": "no xml", "f": good[:60]}
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(text)
    files = invoices.read_invoice_files(spark, str(tmp_path))
    got = invoices.parse_invoices(files, "9").collect()
    assert [(r.path[-5:], r.doc_number, r.counterparty_name) for r in got] == [("a.xml", "7", "A & B")]
    bad = {r.path[-5:-4]: r.reason for r in invoices.quarantined_invoices(files).collect()}
    assert set(bad) | {"a"} >= {"b", "c", "e", "f"} and bad["b"] == "damaged" and bad["c"] == "no_invoice"
    null = spark.createDataFrame([(None, 1)], "xml string, k int")
    assert [tuple(r) for r in invoices.quarantined_invoices(null).collect()] == [(None, 1, "no_invoice")]
    assert invoices.parse_invoices(null, "9").count() == 0


def test_listing_opens_no_file(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"12345")
    listed = documents.list_files(spark, str(tmp_path))
    assert [r.size for r in listed.collect()] == [5]
    schema = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in schema.split("ReadSchema")[-1]


LINES = "report_id string, line_no long, line string"


def _merge(spark, rows, order, known=()):
    lines = spark.createDataFrame([(r, i, t) for i, (r, t) in enumerate(rows)], LINES)
    reports = spark.createDataFrame(order, "report_id string, seq int")
    return {r.code: r.name for r in accounts.merge_reports(lines, reports, list(known)).collect()}


def test_reports_in_turn(spark):
    catch_all = {"9.9.9.99": "Conta a classificar (revisão manual)"}
    assert _merge(spark, [], []) == catch_all
    trial = [("t", "Caixa geral da matriz1.01.01.01.01.0001  1,00 D"), ("t", "Outra conta1.01.01.01.01.0002  1,00 D")]
    sheet = [("s", "BALANÇO PATRIMONIAL"), ("s", "Caixa geral da matriz em moeda   1,00 DB")]
    later = [("u", "Caixa nova1.01.01.01.01.0001  1,00 D")]
    a, b = "1.01.01.01.01.0001", "1.01.01.01.01.0002"
    rows = trial + sheet + later
    assert _merge(spark, rows, [("t", 1), ("s", 2)])[a] == "Caixa geral da matriz em moeda"
    assert _merge(spark, rows, [("s", 1), ("t", 2)])[a] == "Caixa geral da matriz"
    assert _merge(spark, rows, [("t", 1), ("s", 2), ("u", 3)]) == {a: "Caixa nova", b: "Outra conta", **catch_all}
    assert _merge(spark, rows, [("u", 1), ("t", 2), ("s", 3)])[a] == "Caixa geral da matriz em moeda"
    known = [(b, "Known"), ("3.01", "Vendas")]
    assert _merge(spark, rows, [("s", 1), ("t", 2)], known) == {a: "Caixa geral da matriz", b: "Known", "3.01": "Vendas", **catch_all}
    assert _merge(spark, sheet, [("s", 1)], known) == {b: "Known", "3.01": "Vendas", **catch_all}
