"""Ordered rules to double-entry postings.

Rules are data: a DataFrame ``(priority, pattern, category, counter_account, nature)``
that users keep in any table. Two ways to apply them give the same result:

* ``classify``: rules known when the plan is built are folded into one CASE
  column. It short-circuits at the first hit and needs no shuffle.
* ``classify_by_table``: a rule table of any length, read in blocks of ``RULE_BLOCK``
  rules; each block is one CASE of literal patterns, and rows that an earlier block
  took are not looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions.dates import month_of
from tallyweave.functions.text import _c
from tallyweave.schemas import CATCH_ALL, RULES
from tallyweave.session import once

RULE_BLOCK = 200
VERIFY = "a_verificar"  # fixed value: nature whose rows wait for review
UNCLASSIFIED = "Não classificado ⚠️"  # fixed value: category of rows no rule takes

# The standard bank-history rules, in priority order
# (pattern, category, counter account, nature). Company-specific names come in
# through ``standard_rules`` parameters.
BANK_RULES: list[tuple[str, str, str, str]] = [
    (r"TRANSFER[ÊE]NCIA AUTOM\.?\s*RECEBIDA\s*8840", "Recebimento cartão (concentrador Itaú)", "1.01.03.01.02.0003", "operacional"),
    (r"TRANSFER[ÊE]NCIA AUTOM\.?\s*RECEBIDA\s*H\s*II", "Recebimento cartão (concentrador)", "1.01.03.01.02.0003", "operacional"),
    (r"TEG EX GAR", "Repasse garantia cartão (TEG)", "1.01.03.01.02.0003", "operacional"),
    (r"PIX - RECEBIDO CREDI ?SHOP", "Recebimento cartão (CrediShop)", "1.01.03.01.02.0001", "operacional"),
    (r"JUROS (SALDO DEVEDOR|EXCESSO|ATRASO|MORA)", "Juros bancários / mora", "4.02.02.01.03", "financeira"),
    (r"^IOF\b", "IOF sobre operações de crédito", "4.02.02.01.03", "financeira"),
    (r"TAR CONTR/RENOV CTA GAR|Tarifa Pacote de Servi", "Tarifa bancária", "4.02.02.01.03", "financeira"),
    (r"FIN VEIC", "Financiamento de veículo - parcela", "2.02.01.01.01", "financeira"),
    (r"PARC(IAL|ELA) GIRO", "Empréstimo capital de giro - parcela", "2.02.01.01.01", "financeira"),
    (r"RENEGOCIA[ÇC][ÃA]O ITAU", "Renegociação de dívida - parcela", "2.02.01.01.01", "financeira"),
    (r"MULTA PARC GIRO", "Multa - atraso empréstimo giro", "4.02.02.01.03", "financeira"),
    (r"BOLETO PAGO|Pagamento de Boleto", "Pagamento a fornecedor (boleto)", "2.01.01.01.01", "operacional"),
]
GENERAL_RULES: list[tuple[str, str, str, str]] = [
    (r"Pix - Recebido|PIX RECEBIDO", "Recebimento cliente diverso", "1.01.03.01.01.0001", "operacional"),
    (r"Compra com Cartao", "Despesa cartão débito/crédito", "4.02.02.01.01", "operacional"),
    (r"Pix - Enviado RECEITA FEDERAL|PIX ENVIADO.*RECEITA FEDERAL", "Pagamento DARF (INSS/IRRF)", "2.01.01.03.02.0005", "imposto"),
    (r"Pix - Enviado CEF MATRIZ|PIX.*CEF MATRIZ", "Pagamento FGTS", "2.01.01.03.02.0003", "imposto"),
    (r"PAGAMENTOS PIX QR-CODE ESTADO DO PIAUI|ESTADO DO PIAUI|GOV PI ARREC ICMS", "Pagamento ICMS", "2.01.01.03.01.0004", "imposto"),
    (r"RENDIMENTOS? REND PAGO APLIC", "Rendimento aplicação financeira", "3.01.04.01.01.0001", "financeira"),
    (r"Pagamento fatura cartao", "Pagamento fatura cartão", "2.01.01.15.02.0001", "operacional"),
]
UTILITY_RULES: list[tuple[str, str, str, str]] = [
    (r"AGUAS DE TERESINA|Agua e Esgoto", "Despesa consumo (água)", "4.02.01.01.04.0001", "operacional"),
    (r"EQUATORIAL PIAUI|Energia Eletrica", "Despesa consumo (energia)", "4.02.01.01.04.0006", "operacional"),
    (r"POSTO|COMBUST[ÍI]VEL", "Despesa combustível", "4.02.01.01.06.0001", "operacional"),
    (r"TIM S A|Telefone", "Despesa telefonia", "4.02.01.01.04.0007", "operacional"),
    (r"PIX (ENVIADO|RECEBIDO)", "Movimentação diversa via PIX ⚠️", CATCH_ALL, VERIFY),
]


def standard_rule_rows(
    partners: list[tuple[str, str, str]] = (),
    own_company: list[str] = (),
    own_account: str = "1.01.01.01.02.0002",
    payroll: list[tuple[str, str]] = (),
    vendors: list[tuple[str, str, str]] = (),
    services: list[tuple[str, str, str]] = (),
) -> list[tuple[int, str, str, str, str]]:
    """The standard rule list in priority order.

    ``partners`` are ``(pattern, category, account)`` rows and come first, then
    ``own_company`` patterns posting to ``own_account``; ``payroll``
    ``(pattern, category)`` and ``vendors`` come before generic receipts;
    ``services`` come before utilities.
    """
    rows: list[tuple[str, str, str, str]] = []
    rows += [(p, c, a, "societaria") for p, c, a in partners]
    rows += [(p, "Transferência entre contas próprias", own_account, "interna") for p in own_company]
    rows += BANK_RULES
    rows += [(p, c, "4.02.01.01.01.0002", "operacional") for p, c in payroll]
    rows += [(p, c, a, "operacional") for p, c, a in vendors]
    rows += GENERAL_RULES
    rows += [(p, c, a, "operacional") for p, c, a in services]
    rows += UTILITY_RULES
    return [(i + 1, *r) for i, r in enumerate(rows)]


def rules_frame(spark: SparkSession, rows: list[tuple[int, str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, RULES)


def haystack(description="description", counterparty="counterparty") -> Column:
    return F.concat(_c(description), F.lit(" "), F.coalesce(_c(counterparty), F.lit("")))


def _pattern(p: str, whole_words: bool) -> str:
    return rf"(?iu)\b(?:{p})\b" if whole_words else f"(?iu){p}"


HIT = "struct<category:string,counter_account:string,status:string>"


def classify_column(rows: list[tuple[int, str, str, str, str]], text: Column, whole_words: bool = False, otherwise: Column | None = None) -> Column:
    """One CASE over the rule list: struct of category, counter_account, status; ``otherwise`` where no rule fits."""

    def hit(category: str, account: str, nature: str) -> Column:
        status = "manual_review" if nature == VERIFY else "matched"
        return F.struct(
            F.lit(category).alias("category"), F.lit(account).alias("counter_account"), F.lit(status).alias("status")
        )

    out = hit(UNCLASSIFIED, CATCH_ALL, VERIFY) if otherwise is None else otherwise
    for _, p, category, account, nature in sorted(rows, reverse=True):
        out = F.when(text.rlike(_pattern(p, whole_words)), hit(category, account, nature)).otherwise(out)
    return out


def classify(
    tx: DataFrame, rows: list[tuple[int, str, str, str, str]], whole_words: bool = False
) -> DataFrame:
    """Adds category, counter_account and status by the first matching rule."""
    return (
        tx.withColumn("_rule", classify_column(rows, haystack(), whole_words))
        .select("*", "_rule.category", "_rule.counter_account", "_rule.status")
        .drop("_rule")
    )


def classify_by_table(tx: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``classify`` for a rule table of any length.

    Patterns become literals, compiled once for a task, and a row passes through the
    blocks until one takes it. Each block is a generator, so no later block repeats it.
    """
    ordered = rules.select("priority", "pattern", "category", "counter_account", "nature").orderBy("priority", "pattern")
    out = once(tx, _hay=haystack(), _hit=F.lit(None).cast(HIT))
    block: list[tuple[int, str, str, str, str]] = []

    def through(df: DataFrame) -> DataFrame:
        case = classify_column(block, F.col("_hay"), otherwise=F.lit(None).cast(HIT))
        return once(df, _hit=F.when(F.col("_hit").isNull(), case).otherwise(F.col("_hit")))

    for r in ordered.toLocalIterator():
        block.append(tuple(r))
        if len(block) == RULE_BLOCK:
            out, block = through(out), []
    if block:
        out = through(out)
    last = F.struct(F.lit(UNCLASSIFIED).alias("category"), F.lit(CATCH_ALL).alias("counter_account"), F.lit("manual_review").alias("status"))
    return out.withColumn("_hit", F.coalesce("_hit", last)).select(*[F.col(f"`{c}`") for c in tx.columns], "_hit.category", "_hit.counter_account", "_hit.status")


def post_double_entry(classified: DataFrame, bank_coa: str = "bank_coa") -> DataFrame:
    """Money in debits the bank; money out (and zero) credits it. The ledger amount is absolute."""
    inflow = F.col("amount") > 0
    return (
        classified.withColumn("debit_account", F.when(inflow, F.col(bank_coa)).otherwise(F.col("counter_account")))
        .withColumn("credit_account", F.when(inflow, F.col("counter_account")).otherwise(F.col(bank_coa)))
        .withColumn("amount", F.abs("amount"))
    )


def build_ledger(
    tx: DataFrame, bank_accounts: DataFrame, rows: list[tuple[int, str, str, str, str]]
) -> DataFrame:
    """One ledger line per transaction, keyed by the transaction.

    Bank code: the code scanned with the file, else the account table's, else
    the account id itself. ``bank_accounts`` is the account dimension; it is
    joined without a hint, so Spark broadcasts it only below its own threshold.
    """
    banks = bank_accounts.select("bank_account_id", F.col("coa_code").alias("_coa"))
    scanned = F.col("scanned_coa") if "scanned_coa" in tx.columns else F.lit(None).cast("string")
    with_bank = tx.join(banks, "bank_account_id", "left").withColumn(
        "bank_coa", F.coalesce(scanned, F.col("_coa"), F.col("bank_account_id"))
    ).withColumn("signed_amount", F.col("amount"))
    return post_double_entry(classify(with_bank, rows)).select(
        F.col("tx_id").alias("entry_id"),
        "tx_id",
        F.col("tx_date").alias("entry_date"),
        month_of("tx_date").alias("month"),
        "description",
        "counterparty",
        "bank_account_id",
        "bank_coa",
        "category",
        "status",
        "amount",
        "debit_account",
        "credit_account",
        "signed_amount",
    )
