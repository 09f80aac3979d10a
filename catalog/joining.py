"""Lookups and star joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import CALENDAR, SALES, query
from catalog.tables import fact, order_calendar, sales, star_customers, table
from quitanda.operators import joins
from quitanda.operators.aggregates import rank_top
from quitanda.operators.rows import current_rows


def _customers(spark, sf, keep):
    """Customers with a formatted CPF; ``keep`` picks those the lookup knows."""
    c = star_customers(spark, sf).where(keep)
    return c.select(F.concat(F.lit("cpf-"), F.col("cpf")).alias("cpf"), "nome", "uf", "segmento_cliente")


_KNOWN = "sk_cliente % 25 <> 3"


@query("sales_enriched", f"""WITH {SALES} SELECT id_pedido, cpf_cliente, valor_total,
CASE WHEN sk_cliente % 25 <> 3 THEN nome END AS nome, CASE WHEN sk_cliente % 25 <> 3 THEN uf END AS uf,
CASE WHEN sk_cliente % 25 <> 3 THEN segmento_cliente END AS segmento_cliente FROM sales""")
def sales_enriched(spark, sf):
    return joins.enrich_sales(sales(spark, sf, "id_pedido", "cpf_cliente", "valor_total"), _customers(spark, sf, _KNOWN))


@query("join_match_rate", f"""WITH {SALES}, m AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (sk_cliente % 25 <> 3) AS com_cliente FROM sales)
SELECT total, com_cliente, total - com_cliente AS sem_cliente, com_cliente * 100.0::DOUBLE / total AS pct FROM m""")
def join_match_rate(spark, sf):
    return joins.match_rate(joins.enrich_sales(sales(spark, sf, "cpf_cliente"), _customers(spark, sf, _KNOWN)), "nome")


def _versions(spark, sf):
    """Two versions per customer in ten: the old one closed at the end of 1997."""
    c = star_customers(spark, sf).select("sk_cliente", "cpf", "segmento_cliente")
    moved = F.col("sk_cliente") % 10 == 0
    first = F.lit("1990-01-01").cast("date")
    old = c.where(moved).select(
        (F.col("sk_cliente") + 1_000_000_000).alias("sk_cliente"), "cpf", F.lit("ANTIGO").alias("segmento_cliente"),
        first.alias("data_inicio_vigencia"), F.lit("1997-12-31").cast("date").alias("data_fim_vigencia"),
        F.lit(False).alias("registro_atual"))
    now = c.select("*", F.when(moved, F.lit("1998-01-01").cast("date")).otherwise(first).alias("data_inicio_vigencia"),
                   F.lit(None).cast("date").alias("data_fim_vigencia"), F.lit(True).alias("registro_atual"))
    return old.unionByName(now)


@query("lookup_customer", f"""WITH {SALES} SELECT id_pedido, cpf_cliente, sk_cliente, valor_total FROM sales""")
def lookup_customer(spark, sf):
    s = sales(spark, sf, "id_pedido", "cpf_cliente", "valor_total")
    return joins.lookup_customer(s, _versions(spark, sf))


@query("lookup_date", f"""WITH {SALES} SELECT id_pedido, sk_tempo, valor_total FROM sales""")
def lookup_date(spark, sf):
    s = sales(spark, sf, "id_pedido", "data_venda", "valor_total")
    return joins.lookup_date(s, order_calendar(spark, sf)).drop("data_venda")


def _products(spark, sf):
    p = table(spark, sf, "part")
    return p.where("p_partkey % 40 <> 7").select(
        (F.col("p_partkey") + 1).alias("sk_produto"), F.col("p_partkey").alias("produto_id"),
        F.lit(True).alias("registro_atual"))


@query("lookup_product", f"""WITH {SALES} SELECT id_pedido, produto_id,
CASE WHEN produto_id % 40 <> 7 THEN produto_id + 1 END AS sk_produto FROM sales""")
def lookup_product(spark, sf):
    return joins.lookup_product(sales(spark, sf, "id_pedido", "produto_id"), _products(spark, sf))


@query("new_customers", """SELECT CAST(c_custkey AS VARCHAR) AS cpf FROM customer WHERE c_custkey % 25 = 3""")
def new_customers(spark, sf):
    stg = star_customers(spark, sf).select("cpf")
    return joins.new_customers(stg, star_customers(spark, sf).where(_KNOWN))


@query("new_products", """SELECT DISTINCT l_partkey AS produto_id FROM lineitem WHERE l_partkey % 40 = 7""")
def new_products(spark, sf):
    return joins.new_products(sales(spark, sf, "produto_id").distinct(), _products(spark, sf))


@query("orphan_sales", f"""WITH {SALES} SELECT COUNT(*) AS sem_cliente, CAST(SUM(valor_total) AS DECIMAL(18,2)) AS valor
FROM sales WHERE sk_cliente % 25 = 3""")
def orphan_sales(spark, sf):
    s = sales(spark, sf, "cpf_cliente", "valor_total")
    orphans = joins.orphan_sales(s, star_customers(spark, sf).where(_KNOWN))
    return orphans.agg(F.count("*").alias("sem_cliente"), F.sum("valor_total").cast("decimal(18,2)").alias("valor"))


@query("star_top_sales", f"""WITH {SALES}, {CALENDAR} SELECT t.data_completa, s.nome, s.uf, s.valor_total, s.desconto, s.canal_venda,
CAST(row_number() OVER (ORDER BY valor_total DESC, s.data_venda, s.sk_cliente, s.desconto) AS INTEGER) AS ranking
FROM sales s JOIN calendario t ON t.sk_tempo = s.sk_tempo
ORDER BY valor_total DESC, s.data_venda, s.sk_cliente, s.desconto LIMIT 8""")
def star_top_sales(spark, sf):
    rows = joins.star(fact(spark, sf), order_calendar(spark, sf), star_customers(spark, sf), ["data_completa"], ["nome", "uf"])
    best = rank_top(rows, [F.desc("valor_total"), F.asc("data_venda"), F.asc("sk_cliente"), F.asc("desconto")], 8)
    return best.select("data_completa", "nome", "uf", "valor_total", "desconto", "canal_venda", "ranking")


@query("fact_current_customer", f"""WITH {SALES} SELECT segmento_cliente, COUNT(*) AS vendas FROM sales
WHERE NOT (sk_cliente % 10 = 0 AND year(data_venda) < 1998) GROUP BY 1""")
def fact_current_customer(spark, sf):
    moved = (F.col("sk_cliente") % 10 == 0) & (F.year("data_venda") < 1998)
    f = fact(spark, sf, "sk_cliente", "data_venda").withColumn(
        "sk_cliente", F.when(moved, F.col("sk_cliente") + 1_000_000_000).otherwise(F.col("sk_cliente")))
    return (joins.fact_current_customer(f, _versions(spark, sf), ["segmento_cliente"])
            .groupBy("segmento_cliente").agg(F.count("*").alias("vendas")))


@query("customer_as_of", f"""WITH {SALES} SELECT
CASE WHEN sk_cliente % 10 = 0 AND data_venda < DATE '1998-01-01' THEN 'ANTIGO' ELSE segmento_cliente END AS segmento_cliente,
year(data_venda) AS ano, COUNT(*) AS vendas FROM sales GROUP BY 1, 2""")
def customer_as_of(spark, sf):
    s = sales(spark, sf, "cpf_cliente", "data_venda").select(
        F.col("cpf_cliente").alias("cpf"), F.to_date("data_venda").alias("dia"))
    return (joins.as_of_dim(s, _versions(spark, sf), "cpf", "dia")
            .groupBy("segmento_cliente", F.year("dia").cast("bigint").alias("ano")).agg(F.count("*").alias("vendas")))


@query("current_versions", """SELECT COUNT(*) AS versoes, COUNT(DISTINCT c_custkey) AS clientes FROM customer""")
def current_versions(spark, sf):
    return current_rows(_versions(spark, sf)).agg(
        F.count("*").alias("versoes"), F.countDistinct("cpf").alias("clientes"))
