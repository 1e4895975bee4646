"""All link stages together."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallyweave.operators import links
from tallyweave.operators.names import fitting, holds

LEDGER = "entry_id long, entry_date date, description string, counterparty string, bank_account_id string, bank_coa string, category string, amount decimal(18,2), debit_account string"
FISCAL = "fiscal_id long, issue_date date, counterparty_name string, doc_model string, total_value decimal(18,2), cancelled boolean, xml_path string"
FILES = "file_id long, path string, file_name string, kind string, ext string, bank_account_id string, size long"


def test_inputs_are_made_once(spark):
    """However many stages read them, the rows of ledger, invoices and files are computed once."""
    day, seen = date(2024, 6, 3), {}

    def counted(name, rows, schema):
        n = seen[name] = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                n.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, schema).mapInArrow(count, schema)

    ledger = counted("ledger", [
        (1, day, "Pix - Recebido", "ALFA COMERCIO LTDA", "b1", "1.1", "Recebimento cliente", Decimal("10.00"), "1.1"),
        (2, day, "Boleto", "BETA INDUSTRIA LTDA", "b1", "1.1", "Pagamento a fornecedor", Decimal("20.00"), "2.1"),
        (3, day, "Desconto", "GAMA DA SILVA", "b1", "1.1", "Pensão alimentícia", Decimal("30.00"), "4.1")], LEDGER)
    fiscal = counted("fiscal", [
        (11, day, "ALFA COMERCIO LTDA", "55", Decimal("10.00"), False, "share/a.xml"),
        (12, day, "BETA INDUSTRIA LTDA", "55", Decimal("20.00"), False, "share/b.xml")], FISCAL)
    files = counted("files", [
        (21, "share/COMPROVANTES/GAMA DA SILVA.pdf", "GAMA DA SILVA.pdf", "comprovante", ".pdf", "b1", 5),
        (22, "share/COMPROVANTES/BETA INDUSTRIA LTDA.pdf", "BETA INDUSTRIA LTDA.pdf", "comprovante", ".pdf", "b1", 6)], FILES)
    got = links.link_all(ledger, fiscal, files).select("entry_id", "file_path", "stage").where(F.col("stage") != "general").collect()
    assert sorted(map(tuple, got)) == [
        (1, "share/a.xml", "receipts"), (2, "share/COMPROVANTES/BETA INDUSTRIA LTDA.pdf", "suppliers"),
        (2, "share/b.xml", "suppliers"), (3, "share/COMPROVANTES/GAMA DA SILVA.pdf", "deductions")]
    assert {k: n.value for k, n in seen.items()} == {"ledger": 3, "fiscal": 2, "files": 2}


def test_names_longer_than_any_holder_are_not_cut_into_pieces(spark):
    held = ["ALFA", "LFACOM", "ALFACOM", "COMALFACOM", "BETA", "X" * 300]
    holders = ["ALFACOM", "BETA", "ALFA"]
    few, many = spark.createDataFrame([(h,) for h in holders], "h string"), spark.createDataFrame([(x,) for x in held], "x string")
    assert {r.x for r in fitting(many, "x", few, "h").collect()} == {"ALFA", "LFACOM", "ALFACOM", "BETA"}
    assert {tuple(r) for r in holds(few, "h", many, "x").collect()} == {(h, x) for h in holders for x in held if x in h}
    assert not holds(few.where("false"), "h", many, "x").count()


def test_deductions_count_for_the_general_stage(spark):
    """A slip that names an invoice keeps its entry out of the general stage; another slip doesn't, as in the reference."""
    day = date(2024, 6, 3)
    ledger = spark.createDataFrame([(3, day, "Desconto", "GAMA DA SILVA", "b1", "1.1", "Pensão alimentícia", Decimal("30.00"), "4.1")], LEDGER)
    pix = (22, "share/COMPROVANTES/PIX_2024-06-03_GAMA DA SILVA.pdf", "PIX_2024-06-03_GAMA DA SILVA.pdf", "comprovante", ".pdf", "b1", 5)
    danfe = (21, "share/COMPROVANTES/DANFE GAMA DA SILVA.pdf", "DANFE GAMA DA SILVA.pdf", "comprovante", ".pdf", "b1", 5)
    for files, general in (([pix], 1), ([danfe, pix], 0)):
        files = spark.createDataFrame(files, FILES)
        slips = links.deduction_attachments(ledger, files)
        assert slips.count() == 1 and links.file_attachments(ledger, files, slips).count() == general
