"""Ledger-shaped inputs derived from the driver's star-schema tables.

Each view is one SELECT over whole tables, written in SQL that Spark and
DuckDB both accept, so queries and their checks start from equal inputs.
Names, ids and texts are invented.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.operators.classify import standard_rule_rows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_ALIAS = "concat(translate(reverse(lpad(CAST({k} AS STRING), 6, '0')), '0123456789', 'BDFGKLMPRT'), ' LTDA')"
_DOC14 = "lpad(CAST({k} AS STRING), 14, '0')"

VIEWS: dict[str, str] = {
    "tx": f"""
SELECT o.o_orderkey AS tx_id, concat('acct-', CAST(o.o_custkey % 30 AS STRING)) AS bank_account_id,
 CAST(o.o_orderdate AS DATE) AS tx_date,
 CASE o.o_orderpriority
  WHEN '1-URGENT' THEN CASE o.o_custkey % 3 WHEN 0 THEN 'PIX RECEBIDO 2024'
    WHEN 1 THEN concat('Pix - Recebido 01/06 10:20 ', {_DOC14.format(k='o.o_custkey')}, ' ', {_ALIAS.format(k='o.o_custkey')})
    ELSE concat('Pix - Recebido ', {_ALIAS.format(k='o.o_custkey')}) END
  WHEN '2-HIGH' THEN CASE o.o_custkey % 2 WHEN 0 THEN concat('PAGAMENTO DE BOLETO ', c.c_mktsegment)
    ELSE concat('BOLETO PAGO Cp :', CAST(o.o_custkey AS STRING), '-', {_ALIAS.format(k='o.o_custkey')}) END
  WHEN '3-MEDIUM' THEN CASE o.o_custkey % 3 WHEN 0 THEN concat('IOF ', c.c_mktsegment)
    WHEN 1 THEN concat('TRANSFERÊNCIA AUTOM. RECEBIDA 8840 ', c.c_mktsegment) ELSE concat('Pensão mensal ', c.c_mktsegment) END
  WHEN '4-NOT SPECIFIED' THEN concat('POSTO ', c.c_mktsegment, ' ', lpad(CAST(o.o_custkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o.o_orderkey % 60 AS STRING), 2, '0'))
  ELSE CASE o.o_custkey % 2 WHEN 0 THEN concat('DIVERSOS ', c.c_mktsegment) ELSE concat('PIX ENVIADO ', c.c_mktsegment) END END AS description,
 CASE WHEN o.o_custkey % 3 = 0 THEN NULL ELSE {_ALIAS.format(k='o.o_custkey')} END AS counterparty,
 CASE WHEN o.o_custkey % 4 = 0 THEN NULL ELSE {_DOC14.format(k='o.o_custkey')} END AS counterparty_doc,
 CAST(CASE WHEN o.o_orderstatus = 'F' OR o.o_orderpriority = '2-HIGH' THEN -o.o_totalprice ELSE o.o_totalprice END AS DECIMAL(18,2)) AS amount
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "fiscal": f"""
SELECT o.o_orderkey + 1000000000 AS fiscal_id, CAST(o.o_orderkey AS STRING) AS doc_number,
 CASE WHEN o.o_orderkey % 2 = 0 THEN '55' ELSE '65' END AS doc_model,
 CASE WHEN o.o_orderkey % 13 = 0 THEN '5922' WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE '5102' END AS cfop,
 CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 11 - 5 AS INT) AS issue_date,
 CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE {_ALIAS.format(k='o.o_custkey')} END AS counterparty_name,
 {_DOC14.format(k='o.o_custkey')} AS counterparty_doc,
 CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) + CAST(o.o_orderkey % 7 AS INT) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS total_value,
 (o.o_orderkey % 17 = 0) AS cancelled,
 concat('share/', substr(CAST(o.o_orderdate AS STRING), 6, 2), '-', substr(CAST(o.o_orderdate AS STRING), 1, 4),
  CASE o.o_orderkey % 3 WHEN 0 THEN '/XML 06-2024/' WHEN 1 THEN '/XML 06-2024/xml/' ELSE '/outros/' END, lpad(CAST(o.o_orderkey AS STRING), 44, '0'), '.xml') AS xml_path
FROM orders o""",
    "dense_tx": """
SELECT event_id AS tx_id, CAST(ts AS DATE) AS tx_date, CAST(value AS DECIMAL(18,2)) AS amount,
 lpad(CAST(user_id AS STRING), 14, '0') AS counterparty_doc FROM events WHERE event_type = 'purchase'""",
    "dense_fiscal": """
SELECT event_id AS fiscal_id, CAST(ts AS DATE) AS issue_date, CAST(value AS DECIMAL(18,2)) AS total_value,
 lpad(CAST(user_id AS STRING), 14, '0') AS counterparty_doc FROM events WHERE event_type = 'view'""",
    "bank_accounts": """
SELECT concat('acct-', CAST(n_nationkey AS STRING)) AS bank_account_id, n_name AS bank,
 concat('1.01.01.01.02.', lpad(CAST(n_nationkey + 1 AS STRING), 4, '0')) AS coa_code FROM nation""",
    "chart_of_accounts": """
SELECT concat('1.01.01.01.02.', lpad(CAST(n_nationkey + 1 AS STRING), 4, '0')) AS code, concat('Bank ', n_name) AS name, 'ativo' AS type FROM nation
UNION ALL SELECT * FROM (VALUES ('1.01.03.01.01.0001', 'Duplicatas a receber', 'ativo'), ('1.01.03.01.02.0003', 'Cartões a receber', 'ativo'),
 ('2.01.01.01.01', 'Fornecedores', 'passivo'), ('4.02.02.01.03', 'Despesa financeira', 'despesa'),
 ('4.02.01.01.06.0001', 'Combustível', 'despesa'), ('9.9.9.99', 'A classificar', 'despesa')) AS v(code, name, type)""",
    "ledger": """
SELECT tx_id AS entry_id, tx_id, entry_date, month, description, counterparty, bank_account_id, bank_coa, category,
 CASE WHEN category LIKE 'Movimenta%' OR category LIKE 'Não classificado%' THEN 'manual_review' ELSE 'matched' END AS status,
 CAST(abs(amount) AS DECIMAL(18,2)) AS amount,
 CASE WHEN amount > 0 THEN bank_coa ELSE counter END AS debit_account,
 CASE WHEN amount > 0 THEN counter ELSE bank_coa END AS credit_account
FROM (SELECT t.*, t.tx_date AS entry_date, substr(CAST(t.tx_date AS STRING), 1, 7) AS month, coalesce(b.coa_code, t.bank_account_id) AS bank_coa,
 CASE WHEN t.description LIKE 'TRANSFERÊNCIA AUTOM. RECEBIDA 8840%' THEN 'Recebimento cartão (concentrador Itaú)'
  WHEN t.description LIKE 'IOF %' THEN 'IOF sobre operações de crédito'
  WHEN t.description LIKE 'PAGAMENTO DE BOLETO%' OR t.description LIKE 'BOLETO PAGO%' THEN 'Pagamento a fornecedor (boleto)'
  WHEN t.description LIKE 'Pensão mensal%' THEN 'Pensão alimentícia — desconto folha'
  WHEN t.description LIKE 'Pix - Recebido%' OR t.description LIKE 'PIX RECEBIDO%' THEN 'Recebimento cliente diverso'
  WHEN t.description LIKE 'POSTO%' THEN 'Despesa combustível'
  WHEN t.description LIKE 'PIX ENVIADO%' THEN 'Movimentação diversa via PIX ⚠️' ELSE 'Não classificado ⚠️' END AS category,
 CASE WHEN t.description LIKE 'TRANSFERÊNCIA AUTOM. RECEBIDA 8840%' THEN '1.01.03.01.02.0003'
  WHEN t.description LIKE 'IOF %' THEN '4.02.02.01.03'
  WHEN t.description LIKE 'PAGAMENTO DE BOLETO%' OR t.description LIKE 'BOLETO PAGO%' THEN '2.01.01.01.01'
  WHEN t.description LIKE 'Pensão mensal%' THEN '4.02.01.01.01.0002'
  WHEN t.description LIKE 'Pix - Recebido%' OR t.description LIKE 'PIX RECEBIDO%' THEN '1.01.03.01.01.0001'
  WHEN t.description LIKE 'POSTO%' THEN '4.02.01.01.06.0001' ELSE '9.9.9.99' END AS counter
FROM tx t LEFT JOIN bank_accounts b ON b.bank_account_id = t.bank_account_id) x""",
    "files": f"""
SELECT file_id, bank_account_id, modified, size, concat('share/', mm, '/', folder, '/', file_name) AS path, file_name
FROM (SELECT o.o_orderkey AS file_id, concat('acct-', CAST(o.o_custkey % 30 AS STRING)) AS bank_account_id,
 CAST(o.o_orderdate AS DATE) + 5 AS modified, o.o_custkey * 7 + 100 AS size,
 concat(substr(CAST(o.o_orderdate AS STRING), 6, 2), '-', substr(CAST(o.o_orderdate AS STRING), 1, 4)) AS mm,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'COMPROVANTES' WHEN 1 THEN 'COMPROVANTES' WHEN 2 THEN 'COMPROVANTES' WHEN 3 THEN 'NOTAS FISCAL DE ENTRADA' ELSE 'XML 06-2024' END AS folder,
 CASE o.o_orderkey % 5
  WHEN 0 THEN concat(CAST(o.o_orderkey AS STRING), ' - ', substr(ds, 9, 2), substr(ds, 6, 2), substr(ds, 1, 4), ' - Pagamento - ', money, '.pdf')
  WHEN 1 THEN concat(CAST(o.o_orderkey AS STRING), ' - ', substr(far, 9, 2), substr(far, 6, 2), substr(far, 1, 4), ' - ', alias, ' - ', money, '.pdf')
  WHEN 2 THEN concat('PIX_', ds, '_', alias, '.pdf')
  WHEN 3 THEN concat(alias, ' nf ', CAST(o.o_orderkey AS STRING), '.pdf')
  ELSE concat(lpad(CAST(o.o_orderkey AS STRING), 44, '0'), '.pdf') END AS file_name
 FROM (SELECT q.*, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT) AS STRING) AS ds, CAST(CAST(o_orderdate AS DATE) + 9 AS STRING) AS far,
   concat(CAST(CAST(floor(cts / 100) AS BIGINT) AS STRING), ',', lpad(CAST(cts % 100 AS STRING), 2, '0')) AS money,
   {_ALIAS.format(k='o_custkey')} AS alias
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) + (o_orderkey % 8) AS cts FROM orders) q) o) z""",
    "fuel_docs": """
SELECT event_id AS doc_id,
 CASE WHEN event_id % 3 = 0 THEN concat('Digitalizado_', substr(s, 1, 4), substr(s, 6, 2), substr(s, 9, 2), '-', substr(s, 12, 2), substr(s, 15, 2), '.pdf')
  WHEN event_id % 3 = 1 THEN concat('combustivel ', substr(s, 9, 2), substr(s, 6, 2), substr(s, 1, 4), '.pdf')
  ELSE concat('Scan_', substr(s, 1, 4), substr(s, 6, 2), substr(s, 9, 2), '_', substr(s, 12, 2), substr(s, 15, 2), substr(s, 18, 2), '.jpg') END AS file_name,
 CAST(ts AS DATE) AS modified, user_id + 1000 AS size
FROM (SELECT event_id, ts, user_id, CAST(ts AS STRING) AS s FROM events WHERE event_type = 'error') z""",
    "fuel_spend": """
SELECT event_id AS entry_id, CAST(ts AS DATE) + CAST(user_id % 2 AS INT) AS entry_date, concat('POSTO ', lpad(CAST(user_id % 24 AS STRING), 2, '0'), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0')) AS description,
 CASE WHEN event_id % 4 = 0 THEN 'POSTO CENTRAL' END AS counterparty, concat('acct-', CAST(user_id % 30 AS STRING)) AS bank_account_id,
 CAST(value AS DECIMAL(18,2)) AS amount, 'Despesa combustível' AS category, '4.02.01.01.06.0001' AS debit_account
FROM events WHERE event_type = 'click'""",
    "overrides": """
SELECT tx_id AS entry_id, n AS seq, CASE WHEN (tx_id + n) % 3 = 0 THEN '4.02.02.01.03' END AS debit_account,
 CASE WHEN (tx_id + n) % 5 = 0 THEN '2.01.01.01.01' END AS credit_account, CASE WHEN (tx_id + n) % 7 = 0 THEN concat('Fixed ', CAST(n AS STRING)) END AS category,
 CASE WHEN (tx_id + n) % 2 = 0 THEN 'matched' WHEN (tx_id + n) % 9 = 0 THEN '' END AS status
FROM tx CROSS JOIN (SELECT * FROM (VALUES (1), (2)) AS v(n)) k""",
    "attachments": """
SELECT file_id * 2 AS entry_id, path AS file_path, concat(CASE WHEN file_name LIKE '0000%' THEN 'DANFE — ' ELSE '' END, file_name) AS file_name, 'pdf' AS file_type,
 CASE WHEN size % 2 = 0 THEN 'exact' ELSE 'fuzzy' END AS match_type, CASE WHEN size % 2 = 0 THEN 0.95E0 ELSE 0.7E0 END AS match_score FROM files
UNION ALL
SELECT CAST(doc_number AS BIGINT) * 3 AS entry_id, xml_path AS file_path, concat('XML NF-e — ', doc_number, '.xml') AS file_name, 'xml' AS file_type,
 'exact' AS match_type, 1.0E0 AS match_score FROM fiscal WHERE NOT cancelled""",
    "recon": """
SELECT t.tx_id, f.fiscal_id FROM tx t JOIN fiscal f ON f.fiscal_id = t.tx_id + 1000000000
WHERE abs(abs(t.amount) - f.total_value) <= 0.02 AND t.tx_date <= f.issue_date + 3 AND f.issue_date <= t.tx_date + 3""",
    "incoming_accounts": """
SELECT concat('2.01.01.01.01.', lpad(CAST(s_suppkey + 1 AS STRING), 4, '0')) AS code, s_name AS name, 'passivo' AS type FROM supplier
UNION ALL SELECT concat('1.01.01.01.02.', lpad(CAST(n_nationkey + 1 AS STRING), 4, '0')) AS code, concat('Conta ', n_name) AS name, 'ativo' AS type FROM nation""",
    "report_lines": """
SELECT p_brand AS report_id, p_partkey * 3 + 1 AS line_no, CASE p_partkey % 3 WHEN 0 THEN concat('   ', p_name) WHEN 1 THEN '* * * ATIVO CIRCULANTE * * *' ELSE concat('12,00 ', p_name, '  ', p_type) END AS line, 'x' AS k FROM part
UNION ALL
SELECT p_brand AS report_id, p_partkey * 3 + 2 AS line_no, concat(CASE p_partkey % 3 WHEN 1 THEN p_name ELSE '' END, {CODE}, '  1.234,56 D') AS line, 'x' AS k FROM part""",
}
_CODE = ("concat('4.', lpad(CAST(p_partkey % 97 AS STRING), 2, '0'), '.01.', lpad(CAST(CAST(floor(p_partkey / 10000) AS BIGINT) % 100 AS STRING), 2, '0'), "
         "'.02.', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'))")
VIEWS["report_lines"] = VIEWS["report_lines"].replace("{CODE}", _CODE)

# Which views a view reads, in build order.
USES: dict[str, tuple[str, ...]] = {
    "ledger": ("tx", "bank_accounts"),
    "overrides": ("tx",),
    "attachments": ("files", "fiscal"),
    "recon": ("tx", "fiscal"),
}

PAYROLL = [("Pensão mensal", "Pensão alimentícia — desconto folha")]
RULE_ROWS = standard_rule_rows(payroll=PAYROLL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived input ``name`` as a DataFrame."""
    sql = VIEWS[name]
    args = {t: table(spark, sf_dir, t) for t in TABLES if _reads(sql, t)}
    args |= {v: view(spark, sf_dir, v) for v in USES.get(name, ())}
    for n in args:
        sql = _ref(sql, n)
    return spark.sql(sql, **args)


def _reads(sql: str, name: str) -> bool:
    import re

    return re.search(rf"\b(?:FROM|JOIN) {name}\b", sql) is not None


def _ref(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)


def with_clause(*names: str) -> str:
    """``WITH`` prefix defining the named views, for the DuckDB side."""
    order: list[str] = []

    def add(n: str) -> None:
        for u in USES.get(n, ()):
            add(u)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n"
