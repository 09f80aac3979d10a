"""Filters, projections, sorts and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import SALES, query
from catalog.tables import sales, staged_customers, restaged_customers, table
from quitanda.functions.text import in_set, null_if_invalid
from quitanda.operators import rows
from quitanda.operators.aggregates import heavy_hitters
from quitanda.operators.keyed import apply_changes, latest_per_key, minus_by_key
from quitanda.operators.quality import STATUSES
from quitanda.operators.ranking import number_rows


def _holey(spark, sf):
    """Sales with injected nulls: an order in seven has no value, one in eleven nothing at all."""
    s = sales(spark, sf, "id_pedido", "produto_id", "data_venda", "valor_total", "status_venda", "quantidade")
    k = F.col("id_pedido")
    gone = k % 11 == 0
    return s.select(
        *[F.when(~gone, F.col(c)).alias(c) for c in ("id_pedido", "produto_id", "data_venda", "status_venda", "quantidade")],
        F.when(~gone & (k % 7 != 0), F.when(k % 5 == 0, -F.col("valor_total")).otherwise(F.col("valor_total"))).alias("valor_total"),
        F.lit("carga").alias("_job_name"))


_HOLEY = f"""WITH {SALES}, furado AS (
  SELECT id_pedido, produto_id, status_venda, quantidade, data_venda,
    CASE WHEN id_pedido % 7 = 0 THEN NULL WHEN id_pedido % 5 = 0 THEN -valor_total ELSE valor_total END AS valor_total
  FROM sales WHERE id_pedido % 11 <> 0)"""


@query("drop_empty_rows", f"{_HOLEY} SELECT id_pedido, produto_id, valor_total FROM furado")
def drop_empty_rows(spark, sf):
    return rows.drop_empty(_holey(spark, sf)).select("id_pedido", "produto_id", "valor_total")


@query("require_value", f"{_HOLEY} SELECT id_pedido, produto_id, valor_total FROM furado WHERE valor_total IS NOT NULL")
def require_value(spark, sf):
    return rows.require(_holey(spark, sf), ["id_pedido", "valor_total"]).select("id_pedido", "produto_id", "valor_total")


@query("positive_sales", f"{_HOLEY} SELECT id_pedido, produto_id, valor_total FROM furado WHERE valor_total > 0")
def positive_sales(spark, sf):
    return rows.positive(_holey(spark, sf), "valor_total").select("id_pedido", "produto_id", "valor_total")


@query("not_null_product", f"{_HOLEY} SELECT COUNT(*) AS vendas FROM furado WHERE produto_id IS NOT NULL")
def not_null_product(spark, sf):
    return rows.not_null(_holey(spark, sf), "produto_id").agg(F.count("*").alias("vendas"))


@query("null_if_invalid", """
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS valor FROM orders""")
def null_if_invalid_values(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", null_if_invalid(F.col("o_totalprice"), F.col("o_orderpriority") != "5-LOW").alias("valor"))


@query("sales_in_range", f"""WITH {SALES} SELECT id_pedido, produto_id, valor_total FROM sales
WHERE data_venda >= DATE '1996-03-01' AND data_venda < DATE '1996-05-01'""")
def sales_in_range(spark, sf):
    s = sales(spark, sf, "id_pedido", "produto_id", "valor_total", "data_venda")
    return rows.in_range(s, "data_venda", date(1996, 3, 1), date(1996, 4, 30)).drop("data_venda")


@query("sales_default_range", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dia FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-06-30' AND DATE '1997-07-01'""")
def sales_default_range(spark, sf):
    o = table(spark, sf, "orders")
    return rows.in_default_range(o, "o_orderdate", date(1997, 7, 1)).select(
        "o_orderkey", F.to_date("o_orderdate").alias("dia"))


@query("net_sales", f"""WITH {SALES} SELECT status_venda, COUNT(*) AS vendas, CAST(SUM(valor_total) AS DECIMAL(18,2)) AS receita
FROM sales WHERE status_venda <> 'CANCELADA' GROUP BY 1""")
def net_sales(spark, sf):
    return rows.exclude_status(sales(spark, sf, "status_venda", "valor_total")).groupBy("status_venda").agg(
        F.count("*").alias("vendas"), F.sum("valor_total").cast("decimal(18,2)").alias("receita"))


@query("known_columns", f"""WITH {SALES} SELECT id_pedido AS pedido, valor_total, status_venda FROM sales""")
def known_columns(spark, sf):
    s = sales(spark, sf, "id_pedido", "valor_total", "status_venda", "quantidade")
    picked = rows.select_existing(s, ["id_pedido", "valor_total", "valor_frete", "status_venda"])
    return rows.rename(picked, {"id_pedido": "pedido"})


@query("audit_columns", """
SELECT o_orderkey, TIMESTAMP '2024-01-02 03:04:05' AS _processed_at, 'carga_pedidos' AS _job_name,
  TIMESTAMP '2024-01-02 03:04:05' AS stg_load_timestamp, 'BATCH_20240102_030405' AS stg_batch_id FROM orders""")
def audit_columns(spark, sf):
    from datetime import datetime

    from quitanda.functions.dates import batch_id

    now = datetime(2024, 1, 2, 3, 4, 5)
    stamped = rows.with_audit(table(spark, sf, "orders").select("o_orderkey"), "carga_pedidos",
                              F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"), batch_id(now))
    return rows.meta_last(stamped)


@query("state_fallback", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS uf FROM customer""")
def state_fallback(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("estado"))
    return c.select("c_custkey", rows.first_existing(c, "uf", "estado").alias("uf"))


@query("default_values", f"""{_HOLEY} SELECT id_pedido, produto_id, COALESCE(CASE WHEN id_pedido % 4 <> 0 THEN quantidade END, 1) AS quantidade,
COALESCE(CASE WHEN id_pedido % 3 <> 0 THEN status_venda END, 'CONCLUIDA') AS status_venda FROM furado""")
def default_values(spark, sf):
    s = rows.drop_empty(_holey(spark, sf))
    k = F.col("id_pedido")
    gaps = s.withColumns({"quantidade": F.when(k % 4 != 0, F.col("quantidade")),
                          "status_venda": F.when(k % 3 != 0, F.col("status_venda"))})
    return rows.with_defaults(gaps, {"quantidade": 1, "status_venda": "CONCLUIDA"}).select(
        k, "produto_id", "quantidade", "status_venda")


@query("changed_customers", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cpf FROM customer
WHERE c_custkey % 10 = 0 OR c_custkey % 30 = 4""")
def changed_customers(spark, sf):
    a, b = staged_customers(spark, sf).alias("a"), restaged_customers(spark, sf).alias("b")
    both = a.join(b, F.col("a.cpf") == F.col("b.cpf"))
    return both.where(rows.changed("a", "b", ("nome", "email", "cidade", "uf", "segmento_cliente"))).select("a.cpf")


@query("sales_of_month", """
SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1998 AND month(o_orderdate) = 2""")
def sales_of_month(spark, sf):
    o = table(spark, sf, "orders").withColumns({"ano": F.year("o_orderdate"), "mes": F.month("o_orderdate")})
    return rows.in_month(o, date(1998, 2, 14)).select("o_orderkey")


@query("any_bad_row", """
SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS negativo,
  EXISTS (SELECT 1 FROM orders WHERE o_custkey IS NULL) AS sem_cliente,
  EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F') AS finalizado""")
def any_bad_row(spark, sf):
    return table(spark, sf, "orders").agg(
        rows.any_row(F.col("o_totalprice") < 0).alias("negativo"), rows.any_row(F.col("o_custkey").isNull()).alias("sem_cliente"),
        rows.any_row(F.col("o_orderstatus") == "F").alias("finalizado"))


@query("known_status", f"""WITH {SALES} SELECT status_venda IN ('CONCLUIDA','CANCELADA','DEVOLVIDA','PENDENTE') AS conhecido,
COUNT(*) AS vendas FROM sales GROUP BY 1""")
def known_status(spark, sf):
    s = sales(spark, sf, "status_venda").withColumn("status_venda", F.lower("status_venda"))
    return s.groupBy(in_set(F.col("status_venda"), STATUSES).alias("conhecido")).agg(F.count("*").alias("vendas"))


@query("union_by_name", """
SELECT o_orderkey AS id, o_custkey AS cliente, CAST(NULL AS DOUBLE) AS saldo FROM orders
UNION ALL SELECT NULL, c_custkey, c_acctbal FROM customer""")
def union_by_name(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cliente"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("cliente"), F.col("c_acctbal").alias("saldo"))
    return rows.union_all([o, c])


@query("distinct_products", f"""WITH {SALES} SELECT DISTINCT produto_id, produto_nome, categoria_produto FROM sales""")
def distinct_products(spark, sf):
    return sales(spark, sf, "produto_id", "produto_nome", "categoria_produto").distinct()


@query("latest_per_customer", """
SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM (
    SELECT o_custkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS o_orderdate, o_orderkey, o_totalprice FROM orders))
WHERE n = 1""")
def latest_per_customer(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("o_orderdate"),
        "o_orderkey", "o_totalprice")
    return latest_per_key(o, ["o_custkey"], ["o_orderdate"])


@query("dedup_customers", """
SELECT cpf, max(nome) AS nome FROM (
  SELECT c_custkey % 997 AS cpf, c_name AS nome FROM customer) GROUP BY 1""")
def dedup_customers(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 997).alias("cpf"), F.col("c_name").alias("nome"))
    return latest_per_key(c, ["cpf"], [])


@query("customers_without_orders", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def customers_without_orders(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return minus_by_key(table(spark, sf, "customer"), o, ["c_custkey"]).select("c_custkey", "c_name")


@query("apply_changes", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
FROM orders WHERE o_orderkey % 4 <> 2
UNION ALL SELECT o_orderkey + 1000000000, 'N', o_totalprice FROM orders WHERE o_orderkey % 4 = 3""")
def apply_changes_feed(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    update = base.where(k % 4 == 1).withColumns({"o_orderstatus": F.lit("X"), "op": F.lit("U"), "seq": F.lit(2)})
    stale = base.where(k % 4 == 1).withColumns({"o_orderstatus": F.lit("velho"), "op": F.lit("U"), "seq": F.lit(1)})
    delete = base.where(k % 4 == 2).withColumns({"op": F.lit("D"), "seq": F.lit(1)})
    insert = base.where(k % 4 == 3).withColumns({
        "o_orderkey": k + 1_000_000_000, "o_orderstatus": F.lit("N"), "op": F.lit("I"), "seq": F.lit(1)})
    feed = rows.union_all([update, stale, delete, insert])
    return apply_changes(base, feed, ["o_orderkey"], "seq")


@query("largest_orders", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def largest_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rows.top_n(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query("latest_first", """
SELECT o_orderkey, d AS data, row_number() OVER (ORDER BY d DESC NULLS LAST, o_orderkey) AS posicao FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS d FROM orders)""")
def latest_first(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("data"))
    return number_rows(o, [rows.latest_first("data"), F.asc("o_orderkey")], "posicao")


@query("heavy_hitters", """
SELECT produto_id, COUNT(*) AS qtd FROM (SELECT l_partkey AS produto_id FROM lineitem)
GROUP BY 1 ORDER BY qtd DESC, produto_id LIMIT 5""")
def heavy_hitters_products(spark, sf):
    return heavy_hitters(sales(spark, sf, "produto_id"), "produto_id", 5)
