"""Quality suites, validation and alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import SALES, STATES_SQL, query
from catalog.tables import coded, sales, star_customers, state_of, table
from quitanda.operators import alerts, quality as dq, validation as val
from quitanda.operators.rows import any_row
from quitanda.functions.money import parse_money
from quitanda.schemas import SALE_COLUMNS
from quitanda.session import materialize, scratch_path
from quitanda.sources.arrivals import csv_arrivals, read_sales, validate_arrivals
from quitanda.sources.sinks import quarantine

AS_OF = date(2001, 1, 1)


def _row(i: int, name: str, value: str, low: float) -> str:
    """One check as SQL: value over the CTE ``d``."""
    return (f"SELECT {i} AS ordem, '{name}' AS \"check\", CASE WHEN v >= {low} THEN 'PASSOU' ELSE 'FALHOU' END AS status, "
            f"v >= {low} AS passou, round(v, 4) AS valor_atual, CAST({low} AS DOUBLE) AS minimo_esperado "
            f"FROM (SELECT CAST({value} AS DOUBLE) AS v FROM d)")


def _suite(cte: str, checks) -> str:
    return f"WITH {cte} " + " UNION ALL ".join(_row(i, *c) for i, c in enumerate(checks))


def _share(cond: str, among: str | None = None) -> str:
    hit = f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"
    return f"COALESCE(AVG({hit if among is None else f'CASE WHEN {among} IS NOT NULL THEN {hit} END'}), 0)"


_EMAIL = "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$"
_UFS = STATES_SQL.replace("[", "(").replace("]", ")")
_CUSTOMERS = f"""d AS (SELECT CASE WHEN c_custkey % 40 <> 1 THEN lpad(CAST(c_custkey % 1400 AS VARCHAR), CASE WHEN c_custkey % 16 = 2 THEN 9 ELSE 11 END, '0') END AS cpf,
  CASE WHEN c_custkey % 200 <> 7 THEN c_name END AS nome,
  CASE c_custkey % 12 WHEN 0 THEN NULL WHEN 1 THEN 'sem-arroba' ELSE 'c' || c_custkey || '@x.com' END AS email,
  CASE WHEN c_custkey % 60 = 5 THEN 'zz' ELSE lower({STATES_SQL}[c_custkey % 27 + 1]) END AS uf,
  CASE WHEN c_custkey % 300 = 5 THEN 'B2G' ELSE 'B2B' END AS segmento_cliente FROM customer)"""


def _customers(spark, sf):
    k = F.col("c_custkey")
    n = (k % 1400).cast("string")
    cpf = F.when(k % 40 != 1, F.when(k % 16 == 2, F.lpad(n, 9, "0")).otherwise(F.lpad(n, 11, "0")))
    return table(spark, sf, "customer").select(
        cpf.alias("cpf"), F.when(k % 200 != 7, F.col("c_name")).alias("nome"),
        F.when(k % 12 == 0, F.lit(None)).when(k % 12 == 1, "sem-arroba")
         .otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@x.com"))).alias("email"),
        F.when(k % 60 == 5, "zz").otherwise(F.lower(state_of(k))).alias("uf"),
        F.when(k % 300 == 5, "B2G").otherwise("B2B").alias("segmento_cliente"))


_CUSTOMER_CHECKS = [
    ("CPF não-nulo", _share("cpf IS NOT NULL"), 0.99), ("Nome não-nulo", _share("nome IS NOT NULL"), 0.99),
    ("CPF tamanho válido", _share("length(cpf) BETWEEN 11 AND 14", "cpf"), 0.95),
    ("Email formato válido", _share(f"regexp_matches(email, '{_EMAIL}')", "email"), 0.9),
    ("UF estado válido", _share(f"upper(uf) IN {_UFS}", "uf"), 0.98),
    ("CPF unicidade", "COUNT(DISTINCT cpf)::DOUBLE / COUNT(*)", 0.95),
    ("Volume mínimo (>=10)", "CASE WHEN COUNT(*) >= 10 THEN 1 ELSE 0 END", 1.0),
]


@query("dq_customers", _suite(_CUSTOMERS, _CUSTOMER_CHECKS))
def dq_customers(spark, sf):
    return dq.run_suite(_customers(spark, sf), dq.customer_suite())


_SALES_CHECKS = [
    ("Valor total positivo", _share("valor_total > 0"), 0.99),
    ("Sem outliers extremos (<500k)", _share("NOT COALESCE(valor_total > 500000, FALSE)"), 0.999),
    ("Canal de venda válido", _share("canal_venda IN ('LOJA_FISICA','ECOMMERCE','TELEVENDAS','APP_MOBILE')", "canal_venda"), 0.99),
    ("Status venda válido", _share("status_venda IN ('CONCLUIDA','CANCELADA','DEVOLVIDA','PENDENTE')", "status_venda"), 0.99),
    ("Data venda não-nula", _share("data_venda IS NOT NULL"), 0.99),
    ("Volume mínimo (>=1)", "CASE WHEN COUNT(*) >= 1 THEN 1 ELSE 0 END", 1.0),
]
_FAULTY = f"""{SALES}, d AS (SELECT id_pedido, produto_id, quantidade, data_entrega,
  CASE WHEN id_pedido % 150 = 0 THEN NULL WHEN id_pedido % 150 = 1 THEN 600000 ELSE valor_total END AS valor_total,
  CASE WHEN id_pedido % 30 = 2 THEN 'FAX' ELSE canal_venda END AS canal_venda, status_venda,
  CASE WHEN id_pedido % 80 <> 3 THEN data_venda END AS data_venda FROM sales)"""


def _sales(spark, sf):
    k = F.col("id_pedido")
    s = sales(spark, sf, "id_pedido", "produto_id", "quantidade", "data_entrega", "valor_total", "canal_venda", "status_venda", "data_venda")
    return s.withColumns({
        "valor_total": F.when(k % 150 == 0, F.lit(None)).when(k % 150 == 1, 600000).otherwise(F.col("valor_total")),
        "canal_venda": F.when(k % 30 == 2, "FAX").otherwise(F.col("canal_venda")),
        "data_venda": F.when(k % 80 != 3, F.col("data_venda"))})


@query("dq_sales", _suite(_FAULTY, _SALES_CHECKS))
def dq_sales(spark, sf):
    return dq.run_suite(_sales(spark, sf), dq.sales_suite())


@query("dq_sales_status", f"""WITH r AS ({_suite(_FAULTY, _SALES_CHECKS)}) SELECT bool_and(passou) AS passou,
CASE WHEN bool_and(passou) THEN 'PASSOU' ELSE 'FALHOU' END AS status, COUNT(*) FILTER (passou) AS checks_ok, COUNT(*) AS checks FROM r""")
def dq_sales_status(spark, sf):
    return dq.suite_status(dq.run_suite(_sales(spark, sf), dq.sales_suite()))


@query("dq_rules", _suite(_FAULTY, [
    ("entrega apos venda", _share("data_entrega > data_venda"), 1.0),
    ("produto informado", _share("produto_id IS NOT NULL"), 1.0), ("quantidade minima", _share("quantidade >= 1"), 1.0),
    ("data_venda nao futura", _share("CAST(data_venda AS DATE) <= DATE '2001-01-01'", "data_venda"), 1.0)]))
def dq_rules(spark, sf):
    return dq.run_suite(_sales(spark, sf), [*dq.documented_rules(), dq.expect_not_future("data_venda", AS_OF)])


@query("dq_customer_rules", f"""WITH d AS (SELECT CASE WHEN c_custkey % 90 = 4 THEN NULL ELSE c_acctbal END AS limite,
CASE WHEN c_custkey % 70 = 3 THEN ' ' WHEN c_custkey % 70 = 4 THEN NULL ELSE c_mktsegment END AS cidade FROM customer) """ + " UNION ALL ".join(
    _row(i, *c) for i, c in enumerate([("limite de credito positivo", _share("limite > 0"), 1.0), ("cidade informada", _share("trim(cidade) <> ''"), 1.0)])))
def dq_customer_rules(spark, sf):
    """Both written customer rules, the limit as local money text."""
    k = F.col("c_custkey")
    money = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise("R$ "), F.translate(F.format_number(F.abs("c_acctbal"), 2), ",.", ".,"))
    c = table(spark, sf, "customer").select(
        F.when(k % 90 != 4, money).alias("limite_credito"),
        F.when(k % 70 == 3, " ").when(k % 70 != 4, F.col("c_mktsegment")).alias("cidade"))
    return dq.run_suite(c, dq.documented_customer_rules())


SUITE = """{"expectations": [
 {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "id_pedido"}},
 {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "id_venda"}},
 {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "valor_total", "mostly": 0.99}},
 {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "valor_total", "min_value": 0.01, "max_value": 500000, "mostly": 0.99}},
 {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "canal_venda", "value_set": ["LOJA_FISICA", "ECOMMERCE", "TELEVENDAS", "APP_MOBILE"], "mostly": 0.99}},
 {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "quantidade", "min_value": 1, "max_value": 1000, "mostly": 0.99}},
 {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1, "max_value": 10000000000000}}]}"""


@query("dq_suite_json", _suite(_FAULTY, [
    ("id_pedido existe", "MAX(1)", 1.0), ("id_venda existe", "MAX(0)", 1.0),
    ("valor_total nao nulo", _share("valor_total IS NOT NULL"), 0.99),
    ("valor_total faixa", _share("valor_total BETWEEN 0.01 AND 500000", "valor_total"), 0.99),
    ("canal_venda valores", _share("canal_venda IN ('LOJA_FISICA','ECOMMERCE','TELEVENDAS','APP_MOBILE')", "canal_venda"), 0.99),
    ("quantidade faixa", _share("quantidade BETWEEN 1 AND 1000", "quantidade"), 0.99),
    ("volume >= 1", "CASE WHEN COUNT(*) BETWEEN 1 AND 10000000000000 THEN 1 ELSE 0 END", 1.0)]))
def dq_suite_json(spark, sf):
    return dq.run_suite(_sales(spark, sf), dq.load_suite(SUITE))


@query("dq_reference", f"""WITH {SALES} SELECT COUNT(*) AS total, COUNT(*) FILTER (sk_cliente % 25 = 3) AS sem_referencia,
COUNT(*) FILTER (sk_cliente % 25 <> 3)::DOUBLE / COUNT(*) AS taxa FROM sales""")
def dq_reference(spark, sf):
    dim = star_customers(spark, sf).where("sk_cliente % 25 <> 3")
    return dq.expect_reference(sales(spark, sf, "cpf_cliente"), dim, "cpf_cliente", "cpf")


@query("dq_key", """SELECT 'chave duplicada' AS regra, COUNT(*) AS valor FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)
UNION ALL SELECT 'chave nula', COUNT(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL""")
def dq_key(spark, sf):
    return dq.expect_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_assertions", """SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 1000) AS avisado, EXISTS (SELECT 1 FROM orders WHERE o_custkey IS NULL) AS erro""")
def dq_assertions(spark, sf):
    o = table(spark, sf, "orders")
    dq.assert_none(o, F.col("o_custkey").isNull(), "pedido sem cliente")
    return o.agg(any_row(F.col("o_totalprice") < 1000).alias("avisado"), any_row(F.col("o_custkey").isNull()).alias("erro"))


def _arrived(spark, sf):
    """Sales lines as arrived text, one file per sale month, with injected faults."""
    k = F.col("id_pedido")
    s = sales(spark, sf, "id_pedido", "cpf_cliente", "valor_total", "data_venda", "produto_id")
    price = s.select(
        k.cast("string").alias("id_venda"), "cpf_cliente",
        F.when(k % 997 == 1, F.lit(None)).when(k % 997 == 2, "R$ 0,00").when(k % 997 == 3, "grátis")
         .otherwise(F.col("valor_total").cast("string")).alias("valor_total"),
        F.date_format("data_venda", "yyyy-MM-dd").alias("data_venda"),
        F.concat(F.lit("raw/vendas/"), F.date_format("data_venda", "'ano='yyyy'/mes='MM"), F.lit("/vendas.csv")).alias("_source_file"))
    return price


_ARRIVED = f"""WITH {SALES}, a AS (SELECT id_pedido, 'raw/vendas/ano=' || strftime(data_venda, '%Y/mes=%m') || '/vendas.csv' AS _source_file,
id_pedido % 997 IN (1, 2, 3) OR valor_total < 0.01 AS ruim, CAST(id_pedido AS VARCHAR) AS id_venda, cpf_cliente,
CASE id_pedido % 997 WHEN 1 THEN NULL WHEN 2 THEN 'R$ 0,00' WHEN 3 THEN 'grátis' ELSE CAST(valor_total AS VARCHAR) END AS valor_total,
strftime(data_venda, '%Y-%m-%d') AS data_venda FROM sales)"""


@query("validate_files", f"""{_ARRIVED} SELECT _source_file, COUNT(*) AS total_registros, COUNT(*) FILTER (ruim) AS registros_invalidos,
COUNT(*) FILTER (ruim) AS erros, CAST(0 AS BIGINT) AS avisos, '' AS colunas_ausentes, COUNT(*) FILTER (ruim) = 0 AS valido FROM a GROUP BY 1""")
def validate_files(spark, sf):
    return val.validate_files(_arrived(spark, sf), val.SPECS["vendas"])


_LAYOUTS = {  # columns of each layout, in its order
    "contrato": tuple(c for c in SALE_COLUMNS if c != "data_cancelamento"),
    "sem_cpf": ("id_venda", "valor_total", "data_venda"),
    "extra": (*SALE_COLUMNS, "cupom"),
    "maiuscula": ("DATA_VENDA", "Valor_Total", "CPF_CLIENTE", "ID_VENDA", "quantidade", "Canal_Venda", "Produto_Nome"),
}


def arrived_folder(spark, sf) -> str:
    """Sales CSV in four layouts, a folder each, with one broken and one empty file."""
    path = scratch_path(spark, "chegados")
    k = F.col("id_pedido")
    s = sales(spark, sf, "id_pedido", "cpf_cliente", "valor_total", "data_venda", "quantidade", "canal_venda", "produto_nome")
    local = F.concat(F.lit("R$ "), F.translate(F.format_number("valor_total", 2), ",.", ".,"))
    values = {"id_venda": k.cast("string"), "id_pedido": k.cast("string"), "cpf_cliente": F.col("cpf_cliente"),
              "valor_total": F.when(k % 997 < 3, "R$ 0,00").otherwise(local), "data_venda": F.date_format("data_venda", "yyyy-MM-dd"),
              "quantidade": F.col("quantidade").cast("string"), "canal_venda": F.col("canal_venda"), "produto_nome": F.col("produto_nome"),
              "cupom": F.lit("x")}
    for i, (name, columns) in enumerate(_LAYOUTS.items()):
        cols = [values.get(c.lower(), F.lit(None).cast("string")).alias(c) for c in columns]
        s.where(k % 4 == i).select(*cols).write.option("header", True).csv(f"{path}/vendas/{name}")
    s.where(k % 50 == 0).select(F.lit("lixo;lixo").alias("value")).coalesce(1).write.text(f"{path}/vendas/quebrado")
    s.where(k < 0).select("cpf_cliente").coalesce(1).write.text(f"{path}/vendas/vazio")
    return path


def _layout(i: int, name: str, expected: str = "", extra: str = "", required: str = "") -> str:
    bad = f"COUNT(*) FILTER (id_pedido % 997 < 3 OR valor_total < 0.01)"
    valid = f"{bad} = 0" if not required else "FALSE"
    return (f"SELECT '{name}' AS layout, COUNT(*) AS total_registros, {bad} AS registros_invalidos, '{required}' AS colunas_ausentes, "
            f"'{expected}' AS esperadas_ausentes, '{extra}' AS colunas_extras, {valid} AS valido FROM sales WHERE id_pedido % 4 = {i}")


_MORE = ",".join(sorted({*_LAYOUTS["contrato"]} - set(val.SPECS["vendas"].expected)))
_NONE = "id_venda,cpf_cliente,valor_total,data_venda"


@query("arrived_columns", f"""WITH {SALES}, lido AS ({" UNION ALL ".join([
    _layout(0, "contrato", extra=_MORE), _layout(1, "sem_cpf", "cpf_cliente,produto_nome,quantidade,canal_venda", required="cpf_cliente"),
    _layout(2, "extra", extra=",".join(sorted([*_MORE.split(","), "cupom", "data_cancelamento"]))), _layout(3, "maiuscula")])})
SELECT * FROM lido UNION ALL SELECT 'quebrado', 0, 0, '{_NONE}', '{_NONE},produto_nome,quantidade,canal_venda', 'lixo;lixo', FALSE FROM (SELECT COUNT(*) FROM sales)
UNION ALL SELECT 'vazio', 0, 0, '{_NONE}', '{_NONE},produto_nome,quantidade,canal_venda', '', FALSE FROM (SELECT COUNT(*) FROM sales)""")
def arrived_columns(spark, sf):
    """Verdicts of files that each have their own columns, put together by layout."""
    found = validate_arrivals(csv_arrivals(spark, arrived_folder(spark, sf)), val.SPECS["vendas"])
    # a task without rows of a layout writes a file with a header only
    filled = found.where("total_registros > 0 OR _source_file RLIKE 'quebrado|vazio'")
    return (filled.groupBy(F.element_at(F.split("_source_file", "/"), -2).alias("layout"), "colunas_ausentes", "esperadas_ausentes", "colunas_extras")
            .agg(F.sum("total_registros").alias("total_registros"), F.sum("registros_invalidos").alias("registros_invalidos"),
                 F.bool_and("valido").alias("valido")))


@query("arrived_rows", f"""WITH {SALES} SELECT id_pedido::VARCHAR AS id_venda, cpf_cliente, CASE WHEN id_pedido % 997 < 3 THEN 0.00 ELSE valor_total END::DECIMAL(15,2) AS valor_total,
CASE WHEN id_pedido % 4 <> 1 THEN produto_nome END AS produto_nome FROM sales WHERE id_pedido % 4 <> 1""")
def arrived_rows(spark, sf):
    """Rows of the layouts that have a customer, read by name; the others are set aside."""
    columns = ("id_venda", "cpf_cliente", "valor_total", "produto_nome")
    rows, _ = read_sales(spark, arrived_folder(spark, sf), columns, F.lit("2024-01-11").cast("timestamp"), ("valor_total", "cpf_cliente"))
    return rows.select("id_venda", "cpf_cliente", parse_money(F.col("valor_total")).cast("decimal(15,2)").alias("valor_total"), "produto_nome")


@query("validation_totals", f"""{_ARRIVED}, f AS (SELECT _source_file, COUNT(*) FILTER (ruim) = 0 AS valido FROM a GROUP BY 1)
SELECT COUNT(*) AS total_arquivos, COUNT(*) FILTER (valido) AS validos, COUNT(*) FILTER (NOT valido) AS invalidos,
CASE WHEN bool_and(valido) THEN 200 ELSE 400 END AS codigo FROM f""")
def validation_totals(spark, sf):
    return val.verdict_totals(val.validate_files(_arrived(spark, sf), val.SPECS["vendas"]))


@query("validate_rows", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'nulo:nome' ELSE '' END AS erros,
CASE WHEN c_custkey % 10 = 2 THEN 'curto:cpf' ELSE '' END AS avisos FROM customer""")
def validate_rows(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(
        k, F.when(k % 10 == 2, "123").otherwise(F.lpad(k.cast("string"), 11, "0")).alias("cpf"),
        F.when(k % 10 != 1, F.col("c_name")).alias("nome"))
    found = val.with_findings(c, val.SPECS["clientes"])
    return found.select(k, F.array_join("erros", ",").alias("erros"), F.array_join("avisos", ",").alias("avisos"))


@query("column_contract", """SELECT 'vendas' AS dataset, 'esperadas_ausentes' AS achado, 'produto_nome,quantidade,canal_venda' AS colunas, COUNT(*) AS linhas FROM lineitem
UNION ALL SELECT 'vendas', 'extras', '', COUNT(*) FROM lineitem UNION ALL SELECT 'vendas', 'obrigatorias_ausentes', '', COUNT(*) FROM lineitem""")
def column_contract(spark, sf):
    a = _arrived(spark, sf)
    found = val.column_report(a, val.SPECS["vendas"])
    rows = F.array(*[F.struct(F.lit(k).alias("achado"), F.lit(",".join(v)).alias("colunas")) for k, v in found.items()])
    return (a.agg(F.count("*").alias("linhas")).select(F.explode(rows).alias("r"), "linhas")
            .select(F.lit("vendas").alias("dataset"), "r.*", "linhas"))


@query("dataset_of_path", """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'clientes' WHEN 1 THEN 'vendas' WHEN 2 THEN 'eventos' END AS dataset, COUNT(*) AS arquivos
FROM orders GROUP BY 1""")
def dataset_of_path(spark, sf):
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("clientes", "vendas", "eventos", "outros")]), (k % 4 + 1).cast("int"))
    path = F.concat(F.lit("s3a://lago/raw/"), name, F.lit("/ano=2024/"), k.cast("string"), F.lit(".json"))
    return table(spark, sf, "orders").groupBy(val.dataset_of(path).alias("dataset")).agg(F.count("*").alias("arquivos"))


@query("quarantine_sales", f"""{_ARRIVED} SELECT CASE WHEN ruim THEN 'quarentena' ELSE 'valido' END AS destino,
id_venda, cpf_cliente, valor_total, data_venda FROM a""")
def quarantine_sales(spark, sf):
    path = scratch_path(spark, "quarentena")
    # written, as every batch and its clean rows read the checked sales again
    found = materialize(val.with_findings(_arrived(spark, sf), val.SPECS["vendas"]).drop("avisos"), "vendas-conferidas")
    for _ in range(2):  # a rerun replaces its batch
        good = quarantine(found, path, "B1")
    kept = ("id_venda", "cpf_cliente", "valor_total", "data_venda")
    bad = spark.read.schema(", ".join(f"{c} string" for c in kept)).json(path)
    to = lambda df, name: df.select(F.lit(name).alias("destino"), *kept)
    return to(bad, "quarentena").unionByName(to(good, "valido"))


@query("freshness_alert", """SELECT MAX(ts) AS ultima_atualizacao, round((epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', MAX(ts)))) / 3600.0, 4) AS horas,
epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', MAX(ts))) > 25 * 3600 AS alerta FROM events""")
def freshness_alert(spark, sf):
    out = alerts.freshness_alert(table(spark, sf, "events"), "ts", F.lit("2024-02-01").cast("timestamp"))
    return out.withColumn("horas", F.round("horas", 4))


@query("pass_rate_alert", """SELECT o_orderpriority AS dataset, AVG(CASE WHEN o_totalprice > 20000 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM orders GROUP BY 1
HAVING AVG(CASE WHEN o_totalprice > 20000 THEN 1.0 ELSE 0.0 END) < 0.96""")
def pass_rate_alert(spark, sf):
    rates = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(
        F.avg((F.col("o_totalprice") > 20000).cast("double")).alias("pass_rate"))
    return alerts.pass_rate_alert(rates, 0.96)


@query("traffic_light", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'verde' WHEN o_totalprice > 100000 THEN 'amarelo' ELSE 'vermelho' END AS cor FROM orders""")
def traffic_light(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", alerts.traffic_light(F.col("o_totalprice"), 300000, 100000).alias("cor"))


@query("alert_severity", """WITH a AS (SELECT CASE event_type WHEN 'error' THEN 'PIPELINE_FAILURE' WHEN 'view' THEN 'DATA_FRESHNESS_ALERT'
WHEN 'click' THEN 'ROW_COUNT_DROP' ELSE 'OUTRO' END AS tipo FROM events)
SELECT tipo, CASE tipo WHEN 'PIPELINE_FAILURE' THEN 'CRITICO' WHEN 'DATA_FRESHNESS_ALERT' THEN 'MEDIO' WHEN 'ROW_COUNT_DROP' THEN 'ALTO' ELSE 'INFO' END AS nivel,
CASE tipo WHEN 'PIPELINE_FAILURE' THEN 'Pipeline FALHOU' WHEN 'DATA_FRESHNESS_ALERT' THEN 'Dados desatualizados detectados'
WHEN 'ROW_COUNT_DROP' THEN 'Queda no volume de dados detectada' END AS assunto, COUNT(*) AS alertas FROM a GROUP BY ALL""")
def alert_severity(spark, sf):
    raised = table(spark, sf, "events").select(coded(F.col("event_type"), {
        "error": "PIPELINE_FAILURE", "view": "DATA_FRESHNESS_ALERT", "click": "ROW_COUNT_DROP"}, "OUTRO").alias("tipo"))
    return (alerts.with_severity(raised, alerts.alert_rules(spark)).groupBy("tipo", "nivel", "assunto")
            .agg(F.count("*").alias("alertas")))
