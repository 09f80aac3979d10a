"""The SQL surface: functions, warehouse tables and mart views for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quitanda.functions.text import REGIONS, UNKNOWN_REGION
from quitanda.session import LakePaths
from quitanda.sources.versions import Versions

VERSIONED = {"dw": ("dim_clientes", "dim_produto", "dim_tempo"), "dm": ("dm_top_clientes",)}
PLAIN = {"staging": ("stg_clientes",), "dw": ("fato_vendas",),
         "dm": ("dm_vendas_diarias", "dm_vendas_canal")}
PARTITION = {"fato_vendas": "dia DATE", "dm_vendas_diarias": "ano_mes INT", "dm_vendas_canal": "ano_mes INT"}

VIEWS = {
    "vw_kpis_mes_atual": """
        SELECT any_value(ano) AS ano, any_value(mes) AS mes, sum(receita_total) AS receita_mes,
               sum(qtd_vendas) AS pedidos_mes, avg(ticket_medio) AS ticket_medio_mes,
               avg(margem_media_pct) AS margem_media_mes, count(DISTINCT uf) AS estados_atendidos
        FROM dm.dm_vendas_diarias
        WHERE make_date(ano, mes, 1) = trunc(current_date(), 'month')""",
    "vw_receita_yoy": """
        WITH mensal AS (SELECT ano, mes, mes_nome, sum(receita_total) AS receita_total
                        FROM dm.dm_vendas_diarias GROUP BY ALL),
        par AS (SELECT *, lag(receita_total) OVER (PARTITION BY mes ORDER BY ano) AS receita_ano_anterior FROM mensal)
        SELECT *, round(100 * try_divide(receita_total - receita_ano_anterior, receita_ano_anterior), 2) AS crescimento_yoy_pct
        FROM par""",
    "vw_funil_canal": """
        WITH canal AS (SELECT canal_venda, sum(qtd_vendas) AS total_pedidos, sum(receita_total) AS receita_total,
                              avg(ticket_medio) AS ticket_medio, avg(margem_media_pct) AS margem_media_pct
                       FROM dm.dm_vendas_canal GROUP BY canal_venda)
        SELECT *, round(100 * try_divide(receita_total, (SELECT sum(receita_total) FROM canal)), 2) AS share_receita_pct
        FROM canal""",
}


def register_functions(spark: SparkSession) -> None:
    """``uf_para_regiao(uf)`` for SQL users."""
    arms = " ".join(f"WHEN uf IN ({', '.join(repr(s) for s in states)}) THEN '{region}'"
                    for region, states in REGIONS.items())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION uf_para_regiao(uf STRING) RETURNS STRING "
              f"RETURN CASE {arms} ELSE '{UNKNOWN_REGION}' END")


def publish(spark: SparkSession, lake: LakePaths) -> None:
    """Databases, tables over the lake's current folders, and the mart views."""
    places = {(s, t): lake.warehouse(s, t) for s, names in PLAIN.items() for t in names}
    for s, names in VERSIONED.items():
        for t in names:
            path = lake.warehouse(s, t)
            places[s, t] = f"{path}/{Versions(spark, path).current()}"
    for (schema, name), path in places.items():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
        spark.sql(f"DROP TABLE IF EXISTS {schema}.{name}")
        part = PARTITION.get(name, "")
        found = spark.read.parquet(path)
        cols = ", ".join(f"`{c}` {t}" for c, t in found.dtypes if c != part.split(" ")[0])
        by = f"PARTITIONED BY ({part})" if part else ""
        spark.sql(f"CREATE TABLE {schema}.{name} ({cols}) USING parquet {by} LOCATION '{path}'")
        if part:
            spark.sql(f"MSCK REPAIR TABLE {schema}.{name}")
    for name, body in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE VIEW dm.{name} AS {body}")
    register_functions(spark)
