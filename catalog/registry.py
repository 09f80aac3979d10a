"""Registry and the SQL pieces shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quitanda.session import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- SQL pieces: decimal division rounded half up, done on integers so it is exact ---

def exact(num: str, den: str, scale: int, kind: str) -> str:
    n, d = f"CAST(({num}) AS HUGEINT)", f"NULLIF(CAST(({den}) AS HUGEINT), 0)"
    whole = f"((2 * abs({n}) * {10 ** scale} + {d}) // (2 * {d}))"
    signed = f"(CASE WHEN {n} < 0 THEN -1 ELSE 1 END * {whole})"
    unit = f"CAST({10.0 ** -scale:.{scale}f} AS DECIMAL(6,{scale}))"
    return f"CAST(CAST({signed} AS DECIMAL(18,0)) * {unit} AS {kind})"


def cents(e: str, places: int = 2) -> str:
    return f"CAST(CAST({e} AS DECIMAL(18,{places})) * {10 ** places} AS HUGEINT)"


def mean_sql(total: str, count: str, places: int = 2, scale: int = 2, kind: str = "DECIMAL(15,2)") -> str:
    """total / count where total has ``places`` decimals."""
    return exact(cents(total, places), f"({count}) * {10 ** places}", scale, kind)


def pct_sql(part: str, whole: str, scale: int = 2) -> str:
    """part / whole in percent."""
    return exact(f"{cents(part)} * 100", cents(whole), scale, "DECIMAL(18,4)")


def growth_sql(now: str, before: str) -> str:
    return exact(f"({cents(now)} - {cents(before)}) * 100", cents(before), 2, "DECIMAL(18,4)")


def total_sql(e: str) -> str:
    return f"CAST(SUM({e}) AS DECIMAL(18,2))"


STATES_SQL = ("['AC','AL','AP','AM','BA','CE','DF','ES','GO','MA','MT','MS','MG','PA','PB','PR','PE',"
              "'PI','RJ','RN','RS','RO','RR','SC','SP','SE','TO']")


def region_sql(uf: str) -> str:
    return (f"CASE WHEN {uf} IN ('AC','AM','AP','PA','RO','RR','TO') THEN 'NORTE' "
            f"WHEN {uf} IN ('AL','BA','CE','MA','PB','PE','PI','RN','SE') THEN 'NORDESTE' "
            f"WHEN {uf} IN ('DF','GO','MS','MT') THEN 'CENTRO-OESTE' "
            f"WHEN {uf} IN ('ES','MG','RJ','SP') THEN 'SUDESTE' "
            f"WHEN {uf} IN ('PR','RS','SC') THEN 'SUL' ELSE 'DESCONHECIDO' END")


_P = "CAST(l_extendedprice AS DECIMAL(15,2))"
_D = "CAST(l_discount AS DECIMAL(4,2))"
_COST = ("CAST(CAST(l_quantity AS DECIMAL(10,0)) * CAST(p_retailprice AS DECIMAL(15,2))"
         " * CAST(0.55 AS DECIMAL(4,2)) AS DECIMAL(15,2))")

# The sales view every oracle starts from; ``WITH`` list without the keyword.
SALES = f"""priced AS (
  SELECT l_orderkey AS id_pedido, CAST(o_custkey AS VARCHAR) AS cpf_cliente, o_custkey AS sk_cliente,
         l_partkey AS produto_id, o_orderdate AS data_venda, l_shipdate AS data_entrega,
         CAST(l_quantity AS INTEGER) AS quantidade,
         CAST({_P} * (1 - {_D}) AS DECIMAL(15,2)) AS valor_total,
         CAST({_P} * {_D} AS DECIMAL(15,2)) AS desconto, {_COST} AS custo,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'ECOMMERCE' WHEN '2-HIGH' THEN 'APP_MOBILE'
              WHEN '3-MEDIUM' THEN 'TELEVENDAS' ELSE 'LOJA_FISICA' END AS canal_venda,
         CASE l_linestatus WHEN 'O' THEN 'PIX' ELSE 'BOLETO' END AS forma_pagamento,
         CASE l_returnflag WHEN 'R' THEN 'CANCELADA' WHEN 'A' THEN 'DEVOLVIDA' ELSE 'CONCLUIDA' END AS status_venda,
         p_name AS produto_nome, p_type AS categoria_produto,
         n_name AS uf, r_name AS regiao, c_mktsegment AS segmento_cliente, c_name AS nome
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey),
sales AS (
  SELECT *, {exact(f"{cents('valor_total - custo')} * 100", cents('valor_total'), 2, 'DECIMAL(18,4)')} AS margem_pct,
         CAST(strftime(data_venda, '%Y%m%d') AS INTEGER) AS sk_tempo,
         CASE WHEN valor_total < 0 THEN 'DESCONHECIDO' WHEN valor_total < 100 THEN 'PEQUENA'
              WHEN valor_total < 500 THEN 'MEDIA' WHEN valor_total < 2000 THEN 'GRANDE' ELSE 'PREMIUM' END AS categoria_valor
  FROM priced)"""

CALENDAR = """dias AS (
  SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS data_completa
  FROM (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders)),
calendario AS (
  SELECT data_completa, CAST(strftime(data_completa, '%Y%m%d') AS INTEGER) AS sk_tempo,
    CAST(year(data_completa) AS SMALLINT) AS ano, CAST(month(data_completa) AS SMALLINT) AS mes,
    ['Janeiro','Fevereiro','Março','Abril','Maio','Junho','Julho','Agosto','Setembro','Outubro','Novembro','Dezembro'][month(data_completa)] AS mes_nome,
    ['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'][month(data_completa)] AS mes_abrev,
    CAST(quarter(data_completa) AS SMALLINT) AS trimestre,
    CAST(CASE WHEN month(data_completa) <= 6 THEN 1 ELSE 2 END AS SMALLINT) AS semestre,
    CAST(week(data_completa) AS SMALLINT) AS semana_do_ano, CAST(day(data_completa) AS SMALLINT) AS dia,
    CAST(dayofweek(data_completa) + 1 AS SMALLINT) AS dia_semana_num,
    ['Domingo','Segunda-Feira','Terça-Feira','Quarta-Feira','Quinta-Feira','Sexta-Feira','Sábado'][dayofweek(data_completa) + 1] AS dia_semana_nome,
    ['Dom','Seg','Ter','Qua','Qui','Sex','Sab'][dayofweek(data_completa) + 1] AS dia_semana_abrev,
    dayofweek(data_completa) IN (0, 6) AS fim_de_semana, last_day(data_completa) = data_completa AS ultimo_dia_mes
  FROM dias)"""

MART_DAILY = f"""vendas_dia AS (
  SELECT CAST(s.data_venda AS DATE) AS data_venda, t.ano, t.mes, t.mes_nome, t.trimestre,
    t.dia_semana_nome AS dia_semana, t.fim_de_semana, s.uf, s.regiao,
    COUNT(*) AS qtd_vendas,
    COUNT(*) FILTER (canal_venda = 'ECOMMERCE') AS qtd_vendas_ecommerce,
    COUNT(*) FILTER (canal_venda = 'LOJA_FISICA') AS qtd_vendas_loja,
    COUNT(DISTINCT cpf_cliente) AS qtd_clientes_unicos,
    {total_sql('valor_total')} AS receita_total, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio,
    CAST(COALESCE(SUM(valor_total) FILTER (canal_venda = 'ECOMMERCE'), 0) AS DECIMAL(18,2)) AS receita_ecommerce,
    CAST(COALESCE(SUM(valor_total) FILTER (canal_venda = 'LOJA_FISICA'), 0) AS DECIMAL(18,2)) AS receita_loja,
    {total_sql('COALESCE(desconto, 0)')} AS desconto_total,
    {total_sql('COALESCE(valor_total - custo, 0)')} AS margem_total,
    {mean_sql('SUM(COALESCE(margem_pct, 0))', 'COUNT(*)', 4, 4, 'DECIMAL(18,4)')} AS margem_media_pct
  FROM sales s JOIN calendario t ON t.sk_tempo = s.sk_tempo
  WHERE status_venda <> 'CANCELADA' GROUP BY ALL)"""

MART_CHANNEL = f"""canal_base AS (
  SELECT CAST(year(data_venda) AS SMALLINT) AS ano, CAST(month(data_venda) AS SMALLINT) AS mes, canal_venda, forma_pagamento,
    COUNT(*) AS qtd_vendas, COUNT(DISTINCT cpf_cliente) AS qtd_clientes_unicos,
    {total_sql('valor_total')} AS receita_total, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio,
    {total_sql('desconto')} AS desconto_total,
    {mean_sql('SUM(COALESCE(margem_pct, 0))', 'COUNT(*)', 4, 4, 'DECIMAL(18,4)')} AS margem_media_pct
  FROM sales WHERE status_venda <> 'CANCELADA' GROUP BY 1, 2, 3, 4),
vendas_canal AS (
  SELECT *, {pct_sql('receita_total', 'SUM(receita_total) OVER (PARTITION BY ano, mes)')} AS share_receita_pct FROM canal_base)"""

AS_OF = "2002-01-01"
MART_CUSTOMERS = f"""top_clientes AS (
  SELECT CAST(c_custkey AS VARCHAR) AS cpf, c_name AS nome, lower(replace(c_name, '#', '.')) || '@exemplo.com' AS email,
    n_name AS uf, c_mktsegment AS segmento_cliente, COUNT(*) AS total_pedidos,
    {total_sql('valor_total')} AS receita_total, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio,
    CAST(MAX(data_venda) AS DATE) AS ultima_compra, CAST(MIN(data_venda) AS DATE) AS primeira_compra,
    CAST(DATE '{AS_OF}' - CAST(MAX(data_venda) AS DATE) AS INTEGER) AS dias_desde_ultima,
    CAST(DATE '{AS_OF}' - CAST(MIN(data_venda) AS DATE) AS INTEGER) AS dias_como_cliente,
    ROW_NUMBER() OVER (ORDER BY SUM(valor_total) DESC, CAST(c_custkey AS VARCHAR)) AS ranking_receita
  FROM sales JOIN customer ON c_custkey = sk_cliente JOIN nation ON c_nationkey = n_nationkey
  WHERE status_venda <> 'CANCELADA' GROUP BY 1, 2, 3, 4, 5)"""
