"""Aggregated reports and marts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import (
    AS_OF, CALENDAR, MART_CHANNEL, MART_CUSTOMERS, MART_DAILY, SALES, mean_sql, pct_sql, query, total_sql,
)
from catalog.tables import events, fact, order_calendar, sales, star_customers, table
from quitanda.functions.money import MONEY
from quitanda.operators import aggregates as agg
from quitanda.operators.rows import union_all
from quitanda.plans import marts
from quitanda.plans.daily import daily_aggregates

TODAY = date.fromisoformat(AS_OF)
DAY = date(1998, 3, 10)


def daily_mart(spark, sf):
    return marts.mart_daily(fact(spark, sf), order_calendar(spark, sf), star_customers(spark, sf))


@query("mart_daily", f"WITH {SALES}, {CALENDAR}, {MART_DAILY} SELECT * FROM vendas_dia")
def mart_daily(spark, sf):
    return daily_mart(spark, sf)


@query("mart_channel", f"WITH {SALES}, {MART_CHANNEL} SELECT * FROM vendas_canal")
def mart_channel(spark, sf):
    return marts.mart_channel(fact(spark, sf), star_customers(spark, sf))


@query("mart_customers", f"WITH {SALES}, {MART_CUSTOMERS} SELECT * FROM top_clientes")
def mart_customers(spark, sf):
    return marts.mart_customers(fact(spark, sf, "sk_cliente", "data_venda", "valor_total", "status_venda"),
                                star_customers(spark, sf), TODAY)


@query("kpi_month", f"""WITH {SALES}, {CALENDAR}, {MART_DAILY} SELECT 1998 AS ano, 3 AS mes, {total_sql('receita_total')} AS receita_mes,
CAST(SUM(qtd_vendas) AS BIGINT) AS pedidos_mes, {mean_sql('SUM(ticket_medio)', 'COUNT(*)')} AS ticket_medio_mes,
{mean_sql('SUM(receita_total)', 'SUM(qtd_vendas)')} AS ticket_ponderado,
{mean_sql('SUM(margem_media_pct)', 'COUNT(*)', 4, 4, 'DECIMAL(18,4)')} AS margem_media_mes,
COUNT(DISTINCT uf) AS estados_atendidos FROM vendas_dia WHERE ano = 1998 AND mes = 3""")
def kpi_month(spark, sf):
    return marts.kpis_of_month(daily_mart(spark, sf), DAY)


@query("channel_funnel", f"""WITH {SALES}, {MART_CHANNEL}, f AS (SELECT canal_venda, CAST(SUM(qtd_vendas) AS BIGINT) AS total_pedidos,
{total_sql('receita_total')} AS receita_total, {mean_sql('SUM(ticket_medio)', 'COUNT(*)')} AS ticket_medio,
{mean_sql('SUM(margem_media_pct)', 'COUNT(*)', 4, 4, 'DECIMAL(18,4)')} AS margem_media_pct FROM vendas_canal GROUP BY 1)
SELECT *, {pct_sql('receita_total', 'SUM(receita_total) OVER ()')} AS share_receita_pct FROM f""")
def channel_funnel(spark, sf):
    return marts.channel_funnel(marts.mart_channel(fact(spark, sf), star_customers(spark, sf)))


DAILY_UF = f"""SELECT CAST(data_venda AS DATE) AS data, uf, COUNT(valor_total) AS qtd_vendas, {total_sql('valor_total')} AS total_vendas,
{mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio, MIN(valor_total) AS menor_venda, MAX(valor_total) AS maior_venda
FROM sales GROUP BY 1, 2"""


@query("daily_by_uf", f"WITH {SALES} {DAILY_UF}")
def daily_by_uf(spark, sf):
    return agg.daily_by_uf(sales(spark, sf, "data_venda", "uf", "valor_total"))


@query("monthly_by_category", f"""WITH {SALES} SELECT strftime(data_venda, '%Y-%m') AS mes, categoria_produto, categoria_valor,
COUNT(*) AS qtd_vendas, {total_sql('valor_total')} AS total_vendas,
{mean_sql('SUM(margem_pct)', 'COUNT(margem_pct)', 4, 2, 'DECIMAL(10,2)')} AS margem_media FROM sales GROUP BY 1, 2, 3""")
def monthly_by_category(spark, sf):
    return agg.monthly_by_category(
        sales(spark, sf, "data_venda", "categoria_produto", "categoria_valor", "valor_total", "margem_pct"))


TOP_CUSTOMERS = f"""SELECT *, CAST(row_number() OVER (ORDER BY total_gasto DESC, cpf_cliente) AS INTEGER) AS ranking FROM (
SELECT cpf_cliente, COUNT(*) AS qtd_pedidos, {total_sql('valor_total')} AS total_gasto,
{mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio, MAX(data_venda) AS ultima_compra FROM sales GROUP BY 1)
ORDER BY total_gasto DESC, cpf_cliente LIMIT 100"""


@query("top_customers", f"WITH {SALES} {TOP_CUSTOMERS}")
def top_customers(spark, sf):
    return agg.top_customers(sales(spark, sf, "cpf_cliente", "valor_total", "data_venda"))


@query("daily_job_rows", f"""WITH {SALES} SELECT 'vendas_por_dia_uf' AS agregacao, COUNT(*) AS linhas FROM ({DAILY_UF})
UNION ALL SELECT 'top_clientes', COUNT(*) FROM ({TOP_CUSTOMERS})
UNION ALL SELECT 'vendas_por_categoria', COUNT(*) FROM (SELECT DISTINCT strftime(data_venda, '%Y-%m'), categoria_valor FROM sales)""")
def daily_job_rows(spark, sf):
    """Row counts of the daily job's outputs."""
    out = daily_aggregates(sales(spark, sf, "data_venda", "uf", "valor_total", "cpf_cliente", "categoria_valor"))
    counted = [df.agg(F.lit(k).alias("agregacao"), F.count("*").alias("linhas")) for k, df in out.items()]
    return union_all(counted)


@query("channel_totals", f"""WITH {SALES} SELECT canal_venda, COUNT(id_pedido) AS qtd_vendas, {total_sql('valor_total')} AS receita_total,
{mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio FROM sales GROUP BY 1""")
def channel_totals(spark, sf):
    return agg.channel_totals(sales(spark, sf, "canal_venda", "id_pedido", "valor_total"))


@query("channel_split", f"""WITH {SALES} SELECT year(data_venda) AS ano, COUNT(*) FILTER (canal_venda = 'ECOMMERCE') AS qtd_vendas_ecommerce,
COUNT(*) FILTER (canal_venda = 'LOJA_FISICA') AS qtd_vendas_loja,
{total_sql("CASE WHEN canal_venda = 'ECOMMERCE' THEN valor_total ELSE 0 END")} AS receita_ecommerce,
{total_sql("CASE WHEN canal_venda = 'LOJA_FISICA' THEN valor_total ELSE 0 END")} AS receita_loja FROM sales GROUP BY 1""")
def channel_split(spark, sf):
    s = sales(spark, sf, "canal_venda", "data_venda", "valor_total")
    return agg.channel_split(s.withColumn("ano", F.year("data_venda").cast("bigint")), ["ano"])


@query("status_share", f"""WITH {SALES}, b AS (SELECT status_venda, COUNT(*) AS qtd, {total_sql('valor_total')} AS valor FROM sales GROUP BY 1)
SELECT *, {pct_sql('qtd', 'SUM(qtd) OVER ()', 1)} AS pct_qtd FROM b""")
def status_share(spark, sf):
    return agg.status_share(sales(spark, sf, "status_venda", "valor_total"))


@query("top_products", f"""WITH {SALES} SELECT produto_nome, CAST(SUM(quantidade) AS BIGINT) AS unidades, {total_sql('valor_total')} AS receita
FROM sales GROUP BY 1 ORDER BY receita DESC, produto_nome LIMIT 5""")
def top_products(spark, sf):
    return agg.top_products(sales(spark, sf, "produto_nome", "quantidade", "valor_total"))


@query("financial_summary", f"""WITH {SALES} SELECT COUNT(*) AS qtd_vendas, {total_sql('valor_total')} AS receita_total,
{mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio, MAX(valor_total) AS maior_venda, MIN(valor_total) AS menor_venda,
{total_sql('desconto')} AS total_descontos,
{mean_sql('SUM(margem_pct)', 'COUNT(margem_pct)', 4, 2, 'DECIMAL(10,2)')} AS margem_media_pct FROM sales""")
def financial_summary(spark, sf):
    return agg.financial_summary(sales(spark, sf, "valor_total", "desconto", "margem_pct"))


@query("band_totals", f"""WITH {SALES} SELECT categoria_valor, COUNT(*) AS qtd, {total_sql('valor_total')} AS receita,
{mean_sql('SUM(margem_pct)', 'COUNT(margem_pct)', 4, 2, 'DECIMAL(10,2)')} AS margem_media FROM sales GROUP BY 1""")
def band_totals(spark, sf):
    return agg.band_totals(sales(spark, sf, "categoria_valor", "id_pedido", "valor_total", "margem_pct"))


@query("monthly_series", f"""WITH {SALES} SELECT CAST(year(data_venda) AS INTEGER) AS ano_venda, CAST(month(data_venda) AS INTEGER) AS mes_venda,
COUNT(*) AS qtd_vendas, {total_sql('valor_total')} AS receita FROM sales GROUP BY 1, 2""")
def monthly_series(spark, sf):
    return agg.monthly_series(sales(spark, sf, "data_venda", "id_pedido", "valor_total"))


def _segmented(spark, sf):
    c = star_customers(spark, sf)
    b2b = F.col("segmento_cliente").isin("AUTOMOBILE", "MACHINERY")
    limits = table(spark, sf, "customer").select(F.col("c_custkey").alias("sk_cliente"), F.col("c_acctbal").cast(MONEY).alias("limite_credito"))
    return c.join(limits, "sk_cliente").withColumn("segmento_cliente", F.when(b2b, "B2B").otherwise("B2C"))


_SEGMENTED = """segmentado AS (SELECT c_custkey, n_name AS uf, r_name AS regiao, CAST(c_acctbal AS DECIMAL(15,2)) AS limite_credito,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'B2B' ELSE 'B2C' END AS segmento_cliente
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("customer_totals", f"""WITH {_SEGMENTED} SELECT COUNT(*) AS total_clientes, COUNT(DISTINCT uf) AS estados_distintos,
COUNT(*) FILTER (segmento_cliente = 'B2B') AS b2b, COUNT(*) FILTER (segmento_cliente = 'B2C') AS b2c,
{mean_sql('SUM(limite_credito)', 'COUNT(*)')} AS limite_medio FROM segmentado""")
def customer_totals(spark, sf):
    return agg.customer_totals(_segmented(spark, sf))


@query("credit_by_segment", f"""WITH {_SEGMENTED} SELECT segmento_cliente, COUNT(*) AS qtd, {mean_sql('SUM(limite_credito)', 'COUNT(*)')} AS media,
MIN(limite_credito) AS minimo, MAX(limite_credito) AS maximo FROM segmentado GROUP BY 1""")
def credit_by_segment(spark, sf):
    return agg.credit_by_segment(_segmented(spark, sf))


@query("region_share", f"""WITH {_SEGMENTED}, b AS (SELECT regiao, COUNT(*) AS qtd_clientes FROM segmentado GROUP BY 1)
SELECT *, {pct_sql('qtd_clientes', 'SUM(qtd_clientes) OVER ()', 1)} AS pct FROM b""")
def region_share(spark, sf):
    return agg.region_share(star_customers(spark, sf))


@query("uf_counts", f"""WITH {_SEGMENTED}, b AS (SELECT uf, COUNT(*) AS qtd FROM segmentado GROUP BY 1)
SELECT *, {pct_sql('qtd', 'SUM(qtd) OVER ()', 1)} AS pct FROM b""")
def uf_counts(spark, sf):
    return agg.value_counts(star_customers(spark, sf), "uf")


@query("sales_totals", f"""WITH {SALES} SELECT COUNT(*) AS total_vendas, {total_sql('valor_total')} AS receita_total,
{mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio, COUNT(DISTINCT cpf_cliente) AS clientes_compradores FROM sales""")
def sales_totals(spark, sf):
    return agg.sales_totals(sales(spark, sf, "valor_total", "cpf_cliente"))


@query("staging_summary", """
SELECT 'stg_clientes' AS tabela, COUNT(*) AS total_registros, MIN(d) AS primeira_carga, MAX(d) AS ultima_carga
FROM (SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 3) AS d FROM customer)
UNION ALL SELECT 'stg_vendas', COUNT(*), MIN(o_orderdate), MAX(o_orderdate) FROM orders""")
def staging_summary(spark, sf):
    start = F.lit("2024-01-01").cast("date")
    c = table(spark, sf, "customer").select(
        F.date_add(start, (F.col("c_custkey") % 3).cast("int")).cast("timestamp_ntz").alias("stg_load_timestamp"))
    o = table(spark, sf, "orders").select(F.col("o_orderdate").alias("stg_load_timestamp"))
    return agg.staging_summary({"stg_clientes": c, "stg_vendas": o})


@query("quarter_revenue", f"""WITH {SALES} SELECT CAST(year(data_venda) AS SMALLINT) AS ano, CAST(quarter(data_venda) AS SMALLINT) AS trimestre,
COUNT(*) AS qtd_vendas, {total_sql('valor_total')} AS receita, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio,
{mean_sql('SUM(margem_pct)', 'COUNT(margem_pct)', 4, 2, 'DECIMAL(10,2)')} AS margem_media_pct FROM sales GROUP BY 1, 2""")
def quarter_revenue(spark, sf):
    return agg.quarter_revenue(fact(spark, sf, "sk_tempo", "valor_total", "margem_pct"), order_calendar(spark, sf))


@query("numeric_summary", f"""WITH v AS (SELECT 'l_quantity' AS coluna, l_quantity AS x FROM lineitem
UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT coluna, COUNT(x) AS contagem, round(AVG(x), 4) AS media, round(stddev_samp(x), 4) AS desvio, MIN(x) AS minimo, MAX(x) AS maximo,
round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75 FROM v GROUP BY 1""")
def numeric_summary(spark, sf):
    out = agg.numeric_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.withColumns({c: F.round(c, 4) for c in ("media", "desvio", "p25", "p50", "p75")})


@query("column_profile", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders)
SELECT 'o_orderkey' AS coluna, 'bigint' AS tipo, COUNT(*) - COUNT(o_orderkey) AS nulos, (COUNT(*) - COUNT(o_orderkey)) * 100.0::DOUBLE / COUNT(*) AS pct_nulos, CAST(MIN(o_orderkey) AS VARCHAR) AS exemplo FROM o
UNION ALL SELECT 'o_orderstatus', 'string', COUNT(*) - COUNT(o_orderstatus), (COUNT(*) - COUNT(o_orderstatus)) * 100.0::DOUBLE / COUNT(*), MIN(o_orderstatus) FROM o
UNION ALL SELECT 'o_orderpriority', 'string', COUNT(*) - COUNT(o_orderpriority), (COUNT(*) - COUNT(o_orderpriority)) * 100.0::DOUBLE / COUNT(*), MIN(o_orderpriority) FROM o""")
def column_profile(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    return agg.profile_columns(o)


@query("metadata_values", """SELECT DISTINCT '_fonte' AS coluna, o_orderpriority AS valor FROM orders
UNION ALL SELECT '_job_name', 'carga' FROM (SELECT COUNT(*) FROM orders)""")
def metadata_values(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("_fonte"), F.lit("carga").alias("_job_name"))
    return agg.distinct_meta(o)


@query("revenue_of_day", f"""WITH {SALES} SELECT {total_sql('valor_total')} AS receita FROM sales
WHERE CAST(data_venda AS DATE) = DATE '1998-03-10' AND status_venda <> 'CANCELADA'""")
def revenue_of_day(spark, sf):
    return agg.revenue_of_day(daily_mart(spark, sf), DAY)


@query("hourly_volume", """SELECT CAST(hour(ts) AS INTEGER) AS hora, COUNT(*) AS qtd FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1""")
def hourly_volume(spark, sf):
    return agg.hourly_volume(events(spark, sf), date(2024, 1, 10), "timestamp")


@query("load_counts", f"""WITH {SALES} SELECT 'clientes_ativos' AS medida, COUNT(*) AS valor FROM customer
UNION ALL SELECT 'cpf_nulos', COUNT(*) FROM customer WHERE c_custkey IS NULL
UNION ALL SELECT 'vendas', COUNT(*) FROM sales
UNION ALL SELECT 'vendas_do_dia', COUNT(*) FROM sales WHERE CAST(data_venda AS DATE) = DATE '1998-03-10'
UNION ALL SELECT 'valores_negativos', COUNT(*) FROM sales WHERE valor_total < 0""")
def load_counts(spark, sf):
    return agg.load_counts(star_customers(spark, sf), fact(spark, sf, "data_venda", "valor_total"), DAY)


@query("products_by_revenue", f"""WITH {SALES} SELECT produto_id, produto_nome, CAST(SUM(quantidade) AS BIGINT) AS unidades,
{total_sql('valor_total')} AS receita_total, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio FROM sales GROUP BY 1, 2""")
def products_by_revenue(spark, sf):
    return agg.ranked_products(sales(spark, sf, "produto_id", "produto_nome", "quantidade", "valor_total"))


@query("sales_by_uf", f"""WITH {SALES} SELECT uf, regiao, COUNT(*) AS qtd_vendas, COUNT(DISTINCT cpf_cliente) AS qtd_clientes,
{total_sql('valor_total')} AS receita_total, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio FROM sales GROUP BY 1, 2""")
def sales_by_uf(spark, sf):
    return agg.sales_by_uf(sales(spark, sf, "uf", "regiao", "cpf_cliente", "valor_total"))


@query("channel_performance", f"""WITH {SALES}, b AS (SELECT canal_venda, COUNT(*) AS qtd_vendas, COUNT(DISTINCT cpf_cliente) AS qtd_clientes,
{total_sql('valor_total')} AS receita_total, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio,
COUNT(*) FILTER (status_venda = 'CANCELADA') AS canceladas FROM sales GROUP BY 1)
SELECT *, {pct_sql('receita_total', 'SUM(receita_total) OVER ()')} AS share_receita_pct FROM b""")
def channel_performance(spark, sf):
    return agg.channel_performance(sales(spark, sf, "canal_venda", "cpf_cliente", "valor_total", "status_venda"))


@query("zone_stats", """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'processed' ELSE 'archived' END AS zona,
COUNT(*) AS objetos, CAST(SUM(floor(o_totalprice)) AS BIGINT) AS bytes FROM orders GROUP BY 1""")
def zone_stats(spark, sf):
    zone = F.element_at(F.array(F.lit("raw"), F.lit("processed"), F.lit("archived")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    files = table(spark, sf, "orders").select(
        F.concat(zone, F.lit("/vendas/"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("path"),
        F.floor("o_totalprice").alias("bytes"))
    return agg.zone_stats(files)


@query("dq_pass_rate", """SELECT CAST(o_orderdate AS DATE) AS dia, o_orderpriority AS dataset, AVG(CASE WHEN o_totalprice > 50000 THEN 1.0 ELSE 0.0 END) AS pass_rate,
COUNT(*) FILTER (NOT o_totalprice > 50000) AS checks_falhos FROM orders GROUP BY 1, 2""")
def dq_pass_rate(spark, sf):
    reports = table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("dia"), F.col("o_orderpriority").alias("dataset"), (F.col("o_totalprice") > 50000).alias("passou"))
    return agg.dq_pass_rate(reports)
