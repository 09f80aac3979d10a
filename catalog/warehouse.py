"""Staging, dimensions, fact and incremental loads."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import CALENDAR, SALES, STATES_SQL, query, region_sql
from catalog.tables import (
    order_calendar, restaged_customers, sales, staged_customers, star_customers, table,
)
from quitanda.operators import incremental, joins
from quitanda.operators.ranking import number_rows
from quitanda.plans import warehouse as dw
from quitanda.plans.calendar import calendar, days_between, extend_calendar
from quitanda.session import materialize, scratch_path

DAY1, DAY2 = date(2024, 1, 10), date(2024, 1, 11)

_STG = f"""d1 AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cpf, c_name AS nome,
  'c' || c_custkey || '@exemplo.com' AS email, 'Cidade ' || c_nationkey AS cidade,
  {STATES_SQL}[c_nationkey % 27 + 1] AS uf, c_mktsegment AS segmento_cliente, CAST(c_acctbal AS DECIMAL(15,2)) AS limite_credito FROM customer),
d2 AS (SELECT k, cpf, CASE WHEN k % 30 <> 4 THEN nome END AS nome, email, cidade, uf,
  CASE WHEN k % 10 = 0 THEN 'B2B' ELSE segmento_cliente END AS segmento_cliente,
  CASE WHEN k % 7 = 1 THEN CAST(0 AS DECIMAL(15,2)) ELSE limite_credito END AS limite_credito FROM d1),
novos AS (SELECT k + 90000000000 AS k, lpad(CAST(k + 90000000000 AS VARCHAR), 11, '0') AS cpf, nome, email, cidade, uf, segmento_cliente, limite_credito
  FROM d1 WHERE k % 20 = 3),
mudou AS (SELECT k FROM d1 WHERE (k % 10 = 0 AND segmento_cliente <> 'B2B') OR k % 30 = 4),
abertos AS (SELECT d2.* FROM d2 JOIN mudou USING (k) UNION ALL SELECT * FROM novos)"""

_SHOWN = "cpf, nome, cidade, uf, segmento_cliente, limite_credito"


@query("scd2_first_load", f"""WITH {_STG} SELECT row_number() OVER (ORDER BY cpf) AS sk_cliente, {_SHOWN}, {region_sql('uf')} AS regiao,
DATE '2024-01-10' AS data_inicio_vigencia, CAST(NULL AS DATE) AS data_fim_vigencia, TRUE AS registro_atual FROM d1""")
def scd2_first_load(spark, sf):
    return _first(spark, sf).select(*_COLUMNS)


_COLUMNS = ("sk_cliente", "cpf", "nome", "cidade", "uf", "segmento_cliente", "limite_credito", "regiao",
            "data_inicio_vigencia", "data_fim_vigencia", "registro_atual")


def _first(spark, sf):
    stg = staged_customers(spark, sf)
    return dw.scd2_customers(dw.empty_customer_dim(stg, DAY1), stg, DAY1)


_SCD2 = f"""WITH {_STG}, n AS (SELECT COUNT(*) AS n FROM d1)
SELECT row_number() OVER (ORDER BY cpf) AS sk_cliente, {_SHOWN}, {region_sql('uf')} AS regiao, DATE '2024-01-10' AS data_inicio_vigencia,
  CASE WHEN k IN (SELECT k FROM mudou) THEN DATE '2024-01-10' END AS data_fim_vigencia, k NOT IN (SELECT k FROM mudou) AS registro_atual FROM d1
UNION ALL
SELECT n.n + row_number() OVER (ORDER BY cpf), {_SHOWN}, {region_sql('uf')}, DATE '2024-01-11', NULL, TRUE FROM abertos, n"""


@query("scd2_customers", _SCD2)
def scd2_customers(spark, sf):
    """Two loads: the second closes changed versions and opens new ones."""
    first = materialize(_first(spark, sf), "dim_clientes")
    return dw.scd2_customers(first, restaged_customers(spark, sf), DAY2).select(*_COLUMNS)


@query("scd2_repeat", _SCD2)
def scd2_repeat(spark, sf):
    """Loading the second day twice gives what loading it once gives."""
    first = materialize(_first(spark, sf), "dim_clientes")
    stg = restaged_customers(spark, sf)
    once = materialize(dw.scd2_customers(first, stg, DAY2), "dim_clientes")
    return dw.scd2_customers(once, stg, DAY2).select(*_COLUMNS)


@query("closed_versions", f"""WITH {_STG} SELECT cpf, DATE '2024-01-10' AS data_fim_vigencia FROM d1 WHERE k IN (SELECT k FROM mudou)""")
def closed_versions(spark, sf):
    first = materialize(_first(spark, sf), "dim_clientes")
    dim = dw.scd2_customers(first, restaged_customers(spark, sf), DAY2)
    return dim.where(~F.col("registro_atual")).select("cpf", "data_fim_vigencia")


def _staged_sales(spark, sf):
    s = sales(spark, sf, "id_pedido", "cpf_cliente", "produto_id", "produto_nome", "categoria_produto", "data_venda",
              "quantidade", "valor_total", "desconto", "custo", "margem_pct", "canal_venda", "status_venda")
    return s.withColumns({
        "status_venda": F.when(F.col("id_pedido") % 13 != 0, F.col("status_venda")),
        "valor_total": F.when(F.col("id_pedido") % 17 != 0, F.col("valor_total")).otherwise(F.lit(0)).cast("decimal(15,2)"),
    })


@query("product_dim", f"""WITH velho AS (SELECT p_partkey AS produto_id, p_name AS produto_nome, p_type AS categoria, p_partkey + 1 AS sk_produto
FROM part WHERE p_partkey % 4 = 0),
novo AS (SELECT DISTINCT p_partkey AS produto_id, p_name AS produto_nome, p_type AS categoria FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 4 <> 0)
SELECT sk_produto, produto_id, produto_nome, categoria, DATE '2024-01-10' AS data_inicio_vigencia FROM velho
UNION ALL SELECT (SELECT max(sk_produto) FROM velho) + row_number() OVER (ORDER BY produto_id, produto_nome, categoria), produto_id, produto_nome, categoria, DATE '2024-01-11' FROM novo""")
def product_dim(spark, sf):
    stg = sales(spark, sf, "produto_id", "produto_nome", "categoria_produto")
    p = table(spark, sf, "part").where("p_partkey % 4 = 0")
    dim = p.select((F.col("p_partkey") + 1).alias("sk_produto"), F.col("p_partkey").alias("produto_id"),
                   F.col("p_name").alias("produto_nome"), F.col("p_type").alias("categoria"),
                   F.lit(DAY1).alias("data_inicio_vigencia"), F.lit(None).cast("date").alias("data_fim_vigencia"),
                   F.lit(True).alias("registro_atual"))
    return dw.load_products(dim, stg, DAY2).drop("data_fim_vigencia", "registro_atual")


_SPELT = "CASE WHEN id_pedido % 3 = 0 THEN upper(produto_nome) ELSE produto_nome END"


def _spelt_sales(spark, sf):
    s = sales(spark, sf, "id_pedido", "produto_id", "produto_nome", "categoria_produto", "data_venda")
    return s.withColumn("produto_nome", F.when(F.col("id_pedido") % 3 == 0, F.upper("produto_nome")).otherwise(F.col("produto_nome")))


@query("product_spellings", f"""WITH {SALES}, v AS (SELECT id_pedido, produto_id, {_SPELT} AS nome, categoria_produto AS categoria, data_venda FROM sales),
ultimo AS (SELECT *, row_number() OVER (PARTITION BY produto_id ORDER BY data_venda DESC, nome DESC) AS n FROM v)
SELECT produto_id, nome AS produto_nome, categoria, (SELECT COUNT(*) FROM v WHERE v.produto_id = ultimo.produto_id) AS vendas FROM ultimo WHERE n = 1""")
def product_spellings(spark, sf):
    """Products spelt in two ways are one row each, and a sale finds it once."""
    stg = _spelt_sales(spark, sf)
    dim = materialize(dw.load_products(dw.empty_product_dim(stg, DAY1), stg, DAY1), "produtos")
    found = joins.lookup_product(stg.select("id_pedido", "produto_id"), dim)
    sold = found.groupBy("sk_produto").agg(F.count("*").alias("vendas"))
    return dim.join(sold, "sk_produto").select("produto_id", "produto_nome", "categoria", "vendas")


_KNOWN = "sk_cliente % 25 <> 3"


@query("fact_load", f"""WITH {SALES}, b AS (SELECT *, CASE WHEN id_pedido % 17 <> 0 THEN valor_total ELSE 0 END AS valor FROM sales
WHERE data_venda >= DATE '1996-01-01' AND data_venda < DATE '1998-01-01')
SELECT id_pedido, sk_cliente, CASE WHEN produto_id % 40 <> 7 THEN produto_id + 1 END AS sk_produto, sk_tempo, quantidade,
CAST(valor AS DECIMAL(15,2)) AS valor_total, desconto, CAST(valor - custo AS DECIMAL(15,2)) AS margem_valor, margem_pct,
CASE WHEN id_pedido % 13 <> 0 THEN status_venda ELSE 'CONCLUIDA' END AS status_venda, 'BATCH_1' AS dw_batch_id
FROM b WHERE {_KNOWN} AND valor > 0""")
def fact_load(spark, sf):
    return _fact(spark, sf, date(1996, 1, 1), date(1997, 12, 31))


def _fact(spark, sf, start, end):
    products = table(spark, sf, "part").where("p_partkey % 40 <> 7").select(
        (F.col("p_partkey") + 1).alias("sk_produto"), F.col("p_partkey").alias("produto_id"), F.lit(True).alias("registro_atual"))
    rows = dw.fact_rows(_staged_sales(spark, sf), star_customers(spark, sf).where(_KNOWN), products, order_calendar(spark, sf),
                        start, end, F.lit("2024-01-11").cast("timestamp"), "BATCH_1")
    return rows.select("id_pedido", "sk_cliente", "sk_produto", "sk_tempo", "quantidade", "valor_total", "desconto",
                       "margem_valor", "margem_pct", "status_venda", "dw_batch_id")


@query("fact_orphans", f"""WITH {SALES} SELECT COUNT(*) AS sem_cliente FROM sales
WHERE data_venda >= DATE '1996-01-01' AND data_venda < DATE '1998-01-01' AND sk_cliente % 25 = 3""")
def fact_orphans(spark, sf):
    stg = sales(spark, sf, "cpf_cliente", "data_venda")
    return dw.orphan_count(stg, star_customers(spark, sf).where(_KNOWN), date(1996, 1, 1), date(1997, 12, 31))


@query("range_reload", """SELECT o_orderkey, o_orderdate AS data_venda,
CASE WHEN o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-04-01' THEN 'novo' ELSE 'velho' END AS lote FROM orders
WHERE NOT (o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-04-01' AND o_orderkey % 2 = 1)""")
def range_reload(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("data_venda"))
    new = o.where("o_orderkey % 2 = 0").withColumn("lote", F.lit("novo"))
    return incremental.range_reload(o.withColumn("lote", F.lit("velho")), new, "data_venda", date(1996, 2, 1), date(1996, 3, 31))


@query("stage_sales_range", """SELECT o_orderkey, o_orderdate AS data_venda, CASE WHEN o_orderdate >= DATE '1999-01-01' AND o_orderdate < DATE '1999-02-01' THEN 'B2' END AS stg_batch_id,
CASE WHEN o_orderdate >= DATE '1999-01-01' AND o_orderdate < DATE '1999-02-01' THEN TIMESTAMP '2024-01-11' END AS stg_load_timestamp FROM orders""")
def stage_sales_range(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("data_venda"))
    old = o.withColumns({"stg_load_timestamp": F.lit(None).cast("timestamp"), "stg_batch_id": F.lit(None).cast("string")})
    return dw.stage_sales(old, o, date(1999, 1, 1), date(1999, 1, 31), F.lit("2024-01-11").cast("timestamp"), "B2")


@query("stage_customers", """SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cpf, c_name AS nome, 'B1' AS stg_batch_id FROM customer""")
def stage_customers(spark, sf):
    stg = dw.stage_customers(staged_customers(spark, sf), F.lit("2024-01-11").cast("timestamp"), "B1", scratch_path(spark, "stg_clientes"))
    return stg.select("cpf", "nome", "stg_batch_id")


@query("incremental_append", """SELECT year(o_orderdate) AS ano, COUNT(*) AS pedidos FROM orders GROUP BY 1""")
def incremental_append(spark, sf):
    """Two pulls by cursor, each retried: the first up to 1997, the second everything newer than what it left."""
    o = table(spark, sf, "orders")
    target = scratch_path(spark, "pedidos")
    for batch in ("B1", "B1", "B2", "B2"):
        source = o.where(F.year("o_orderdate") <= 1997) if batch == "B1" else o
        incremental.incremental_append(spark, source, target, "o_orderdate", batch)
    return spark.read.parquet(target).groupBy(F.year("o_orderdate").cast("bigint").alias("ano")).agg(F.count("*").alias("pedidos"))


@query("full_refresh", """SELECT c_mktsegment, COUNT(*) AS clientes FROM customer GROUP BY 1""")
def full_refresh(spark, sf):
    target = scratch_path(spark, "clientes")
    c = table(spark, sf, "customer")
    incremental.full_refresh(c.where("c_custkey % 2 = 0"), target)
    incremental.full_refresh(c, target)
    return spark.read.parquet(target).groupBy("c_mktsegment").agg(F.count("*").alias("clientes"))


@query("surrogate_keys", """SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) + 1000 AS sk FROM customer""")
def surrogate_keys(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return number_rows(c, [F.asc("c_name"), F.asc("c_custkey")], "sk", start=1000).drop("c_name")


@query("calendar_extend", f"""WITH {CALENDAR}, tudo AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2006-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT sk_tempo, data_completa FROM calendario UNION
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER), d FROM tudo""")
def calendar_extend(spark, sf):
    have = order_calendar(spark, sf)
    wanted = calendar(days_between(spark, date(1995, 1, 1), date(2006, 12, 31)))
    return extend_calendar(have, wanted).select("sk_tempo", "data_completa")
