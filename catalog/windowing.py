"""Window reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    CALENDAR, MART_CUSTOMERS, MART_DAILY, SALES, growth_sql, mean_sql, pct_sql, query, total_sql,
)
from catalog.tables import events, fact, sales, star_customers, table
from catalog.totals import TODAY, daily_mart
from quitanda.operators import alerts, windows
from quitanda.operators.aggregates import ranked_products, share_of_total
from quitanda.operators.ranking import with_ntile
from quitanda.plans import marts

_CUSTOMER_FACT = ("sk_cliente", "data_venda", "valor_total", "status_venda")


@query("revenue_yoy", f"""WITH {SALES}, {CALENDAR}, {MART_DAILY}, m AS (
SELECT ano, mes, mes_nome, {total_sql('receita_total')} AS receita_total FROM vendas_dia GROUP BY 1, 2, 3),
l AS (SELECT *, LAG(receita_total) OVER (PARTITION BY mes ORDER BY ano) AS receita_ano_anterior FROM m)
SELECT *, {growth_sql('receita_total', 'receita_ano_anterior')} AS crescimento_yoy_pct FROM l""")
def revenue_yoy(spark, sf):
    return marts.revenue_yoy(daily_mart(spark, sf))


@query("daily_growth", f"""WITH {SALES}, {CALENDAR}, {MART_DAILY}, l AS (
SELECT a.data_venda, a.uf, a.receita_total, b.receita_total AS receita_dia_anterior FROM vendas_dia a
LEFT JOIN vendas_dia b ON a.uf = b.uf AND b.data_venda = a.data_venda - 1)
SELECT *, {growth_sql('receita_total', 'receita_dia_anterior')} AS crescimento_pct FROM l""")
def daily_growth(spark, sf):
    return windows.daily_growth(daily_mart(spark, sf)).select(
        "data_venda", "uf", "receita_total", "receita_dia_anterior", "crescimento_pct")


@query("rfm_scores", f"""WITH {SALES}, {MART_CUSTOMERS}, s AS (SELECT *,
CAST(ntile(5) OVER (ORDER BY dias_desde_ultima DESC, cpf) AS INTEGER) AS score_recencia,
CAST(ntile(5) OVER (ORDER BY total_pedidos, cpf) AS INTEGER) AS score_frequencia,
CAST(ntile(5) OVER (ORDER BY receita_total, cpf) AS INTEGER) AS score_monetario FROM top_clientes)
SELECT *, CASE WHEN score_recencia >= 4 AND score_frequencia >= 4 AND score_monetario >= 4 THEN 'Campeao'
WHEN score_frequencia >= 4 AND score_recencia >= 3 THEN 'Cliente Fiel'
WHEN score_recencia >= 4 AND score_frequencia <= 2 THEN 'Novo'
WHEN score_recencia <= 2 AND score_frequencia >= 3 THEN 'Em Risco'
WHEN score_recencia <= 2 AND score_frequencia <= 2 THEN 'Perdido' ELSE 'Regular' END AS segmento_rfm FROM s""")
def rfm_scores(spark, sf):
    return marts.mart_customers_rfm(fact(spark, sf, *_CUSTOMER_FACT), star_customers(spark, sf), TODAY)


@query("revenue_rank", f"""WITH {SALES} SELECT produto_id, receita_total,
row_number() OVER (ORDER BY receita_total DESC, produto_id) AS posicao
FROM (SELECT produto_id, {total_sql('valor_total')} AS receita_total FROM sales GROUP BY 1)""")
def revenue_rank(spark, sf):
    by = sales(spark, sf, "produto_id", "valor_total").groupBy("produto_id").agg(
        F.sum("valor_total").cast("decimal(18,2)").alias("receita_total"))
    return windows.rank_by_revenue(by, "receita_total", "produto_id", "posicao")


_PRODUCT = f"""produto AS (SELECT produto_id, produto_nome, CAST(SUM(quantidade) AS BIGINT) AS unidades,
{total_sql('valor_total')} AS receita_total, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio FROM sales GROUP BY 1, 2)"""


@query("abc_products", f"""WITH {SALES}, {_PRODUCT}, r AS (SELECT *,
row_number() OVER w AS ranking, ntile(10) OVER w AS d,
CAST(SUM(receita_total) OVER (ORDER BY receita_total DESC, produto_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS receita_acumulada,
SUM(receita_total) OVER () AS tudo FROM produto WINDOW w AS (ORDER BY receita_total DESC, produto_id))
SELECT produto_id, produto_nome, unidades, receita_total, ticket_medio, receita_acumulada, ranking,
CASE WHEN d <= 2 THEN 'A' WHEN d <= 5 THEN 'B' ELSE 'C' END AS classificacao_abc,
{pct_sql('receita_acumulada', 'tudo')} AS pct_acumulado FROM r""")
def abc_products(spark, sf):
    return windows.abc_class(ranked_products(sales(spark, sf, "produto_id", "produto_nome", "quantidade", "valor_total")))


@query("cumulative_share", f"""WITH {SALES}, b AS (SELECT sk_cliente, {total_sql('valor_total')} AS receita FROM sales GROUP BY 1),
r AS (SELECT *, CAST(SUM(receita) OVER w AS DECIMAL(28,2)) AS acumulado, row_number() OVER w AS posicao, SUM(receita) OVER () AS tudo
FROM b WINDOW w AS (ORDER BY receita DESC, sk_cliente ROWS UNBOUNDED PRECEDING))
SELECT sk_cliente, receita, acumulado, posicao, {pct_sql('acumulado', 'tudo')} AS pct_acumulado FROM r""")
def cumulative_share(spark, sf):
    by = sales(spark, sf, "sk_cliente", "valor_total").groupBy("sk_cliente").agg(
        F.sum("valor_total").cast("decimal(18,2)").alias("receita"))
    return windows.cumulative_share(by, "receita", "sk_cliente")


@query("order_deciles", """SELECT o_orderkey, o_totalprice, CAST(ntile(10) OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS INTEGER) AS decil FROM orders""")
def order_deciles(spark, sf):
    """Ntile over an order whose first key has five values: each is spread over many blocks."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    order = [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return with_ntile(o, order, 10, "decil").drop("o_orderpriority")


@query("share_in_month", f"""WITH {SALES}, b AS (SELECT strftime(data_venda, '%Y-%m') AS mes, canal_venda, {total_sql('valor_total')} AS receita FROM sales GROUP BY 1, 2)
SELECT *, {pct_sql('receita', 'SUM(receita) OVER (PARTITION BY mes)')} AS share_pct FROM b""")
def share_in_month(spark, sf):
    by = sales(spark, sf, "data_venda", "canal_venda", "valor_total").groupBy(
        F.date_format("data_venda", "yyyy-MM").alias("mes"), "canal_venda").agg(
        F.sum("valor_total").cast("decimal(18,2)").alias("receita"))
    return windows.share_within(by, ["mes"], "receita", "share_pct")


@query("product_share", f"""WITH {SALES}, b AS (SELECT produto_id, {total_sql('valor_total')} AS receita FROM sales GROUP BY 1)
SELECT *, {pct_sql('receita', 'SUM(receita) OVER ()')} AS share_pct FROM b""")
def product_share(spark, sf):
    by = sales(spark, sf, "produto_id", "valor_total").groupBy("produto_id").agg(
        F.sum("valor_total").cast("decimal(18,2)").alias("receita"))
    return share_of_total(by, "receita", "share_pct")


_TYPED = """ev AS (SELECT CASE event_type WHEN 'purchase' THEN 'PURCHASE_COMPLETED' WHEN 'view' THEN 'PRODUCT_VIEW'
WHEN 'click' THEN 'BUTTON_CLICK' ELSE 'PAGE_VIEW' END AS event_type, ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS segundo FROM events)"""


@query("trailing_count", f"""WITH {_TYPED}, s AS (SELECT event_type, segundo, COUNT(*) AS eventos FROM ev GROUP BY 1, 2)
SELECT *, CAST(SUM(eventos) OVER (PARTITION BY event_type ORDER BY segundo RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS ultimos_segundos FROM s""")
def trailing_count(spark, sf):
    """Trailing hour, since the given events are minutes apart."""
    return windows.trailing_count(events(spark, sf), 3600)


@query("row_drop_alert", """WITH d AS (SELECT CAST(ts AS DATE) AS dia, COUNT(*) AS linhas FROM events GROUP BY 1),
l AS (SELECT *, LAG(linhas) OVER (ORDER BY dia) AS linhas_dia_anterior FROM d)
SELECT *, COALESCE(linhas < linhas_dia_anterior * 0.97, FALSE) AS alerta FROM l WHERE linhas < linhas_dia_anterior * 0.97""")
def row_drop_alert(spark, sf):
    daily = events(spark, sf).groupBy(F.to_date("timestamp").alias("dia")).agg(F.count("*").alias("linhas"))
    return alerts.row_drop_alert(daily, 0.97)
