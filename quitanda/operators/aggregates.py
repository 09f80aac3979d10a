"""Reports over sales, customers and events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from quitanda.functions.dates import month_label
from quitanda.functions.money import MONEY, TOTAL, mean_of, percent_of
from quitanda.operators.ranking import running_sum
from quitanda.session import materialize

VALUE = "valor_total"


def total(col: str = VALUE, kind: str = TOTAL) -> Column:
    return F.sum(col).cast(kind)


def mean(col: str = VALUE, kind: str = MONEY) -> Column:
    return mean_of(F.sum(col), F.count(col), kind)


def share_of_total(df: DataFrame, value: str, name: str, scale: int = 2) -> DataFrame:
    """Percent of the column's sum.

    The grouped rows are written once: the sum (a scalar subquery, not a window over one partition)
    would otherwise scan and join the facts a second time.
    """
    kept = materialize(df, "grupos")
    whole = kept.agg(F.sum(value)).scalar()
    return kept.withColumn(name, percent_of(F.col(value), whole, scale))


def daily_by_uf(sales: DataFrame) -> DataFrame:
    keys = [F.to_date("data_venda").alias("data")] + (["uf"] if "uf" in sales.columns else [])
    return sales.groupBy(*keys).agg(
        F.count(VALUE).alias("qtd_vendas"), total().alias("total_vendas"), mean().alias("ticket_medio"),
        F.min(VALUE).alias("menor_venda"), F.max(VALUE).alias("maior_venda"))


def monthly_by_category(sales: DataFrame) -> DataFrame | None:
    """By month, category and value band; None when the frame has neither category column."""
    cats = [c for c in ("categoria_produto", "categoria_valor") if c in sales.columns]
    if not cats:
        return None
    out = [F.count(VALUE).alias("qtd_vendas"), total().alias("total_vendas")]
    if "margem_pct" in sales.columns:
        out.append(mean("margem_pct", "decimal(10,2)").alias("margem_media"))
    return sales.groupBy(month_label(F.col("data_venda")).alias("mes"), *cats).agg(*out)


def top_customers(sales: DataFrame, n: int = 100) -> DataFrame:
    """The n biggest spenders with their rank."""
    key = "cpf_cliente" if "cpf_cliente" in sales.columns else "cpf"
    keys = [key] + (["nome"] if "nome" in sales.columns else [])
    spend = sales.groupBy(*keys).agg(
        F.count(VALUE).alias("qtd_pedidos"), total().alias("total_gasto"),
        mean().alias("ticket_medio"), F.max("data_venda").alias("ultima_compra"))
    return rank_top(spend, [F.desc("total_gasto"), *[F.asc(k) for k in keys]], n)


def rank_top(df: DataFrame, order: list[Column], n: int, name: str = "ranking") -> DataFrame:
    """Keep n rows and number them; the window sees those n rows only."""
    return df.orderBy(*order).limit(n).withColumn(
        name, F.row_number().over(Window.orderBy(*order)))


def channel_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("canal_venda").agg(
        F.count("id_pedido").alias("qtd_vendas"), total().alias("receita_total"),
        mean().alias("ticket_medio"))


def channel_split(fact: DataFrame, keys: list[str]) -> DataFrame:
    """E-commerce against physical store, counts and revenue."""
    online, store = F.col("canal_venda") == "ECOMMERCE", F.col("canal_venda") == "LOJA_FISICA"
    return fact.groupBy(*keys).agg(
        F.count_if(online).alias("qtd_vendas_ecommerce"), F.count_if(store).alias("qtd_vendas_loja"),
        F.coalesce(F.sum(F.when(online, F.col(VALUE))), F.lit(0)).cast(TOTAL).alias("receita_ecommerce"),
        F.coalesce(F.sum(F.when(store, F.col(VALUE))), F.lit(0)).cast(TOTAL).alias("receita_loja"))


def status_share(sales: DataFrame) -> DataFrame:
    by = sales.groupBy("status_venda").agg(F.count("*").alias("qtd"), total().alias("valor"))
    return share_of_total(by, "qtd", "pct_qtd", 1)


def top_products(sales: DataFrame, n: int = 5) -> DataFrame:
    by = sales.groupBy("produto_nome").agg(F.sum("quantidade").alias("unidades"), total().alias("receita"))
    return by.orderBy(F.desc("receita"), F.asc("produto_nome")).limit(n)


def financial_summary(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.count("*").alias("qtd_vendas"), total().alias("receita_total"), mean().alias("ticket_medio"),
        F.max(VALUE).alias("maior_venda"), F.min(VALUE).alias("menor_venda"),
        total("desconto").alias("total_descontos"),
        mean("margem_pct", "decimal(10,2)").alias("margem_media_pct"))


def band_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy("categoria_valor").agg(
        F.count("id_pedido").alias("qtd"), total().alias("receita"),
        mean("margem_pct", "decimal(10,2)").alias("margem_media"))


def monthly_series(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.year("data_venda").alias("ano_venda"), F.month("data_venda").alias("mes_venda")).agg(
        F.count("id_pedido").alias("qtd_vendas"), total().alias("receita")).orderBy("ano_venda", "mes_venda")


def customer_totals(stg: DataFrame) -> DataFrame:
    return stg.agg(
        F.count("*").alias("total_clientes"), F.countDistinct("uf").alias("estados_distintos"),
        F.count_if(F.col("segmento_cliente") == "B2B").alias("b2b"),
        F.count_if(F.col("segmento_cliente") == "B2C").alias("b2c"),
        mean("limite_credito").alias("limite_medio"))


def sales_totals(stg: DataFrame) -> DataFrame:
    return stg.agg(
        F.count("*").alias("total_vendas"), total().alias("receita_total"), mean().alias("ticket_medio"),
        F.countDistinct("cpf_cliente").alias("clientes_compradores"))


def staging_summary(tables: dict[str, DataFrame], loaded: str = "stg_load_timestamp") -> DataFrame:
    """Rows and first/last load per staging table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("tabela"), F.count("*").alias("total_registros"),
                     F.min(loaded).alias("primeira_carga"), F.max(loaded).alias("ultima_carga"))
        out = row if out is None else out.unionByName(row)
    return out


def region_share(dim: DataFrame) -> DataFrame:
    by = dim.where("registro_atual").groupBy("regiao").agg(F.count("*").alias("qtd_clientes"))
    return share_of_total(by, "qtd_clientes", "pct", 1)


def quarter_revenue(fact: DataFrame, calendar: DataFrame) -> DataFrame:
    """Grouped by day before the calendar join, so the join sees one row per day."""
    parts = fact.groupBy("sk_tempo").agg(
        F.count("*").alias("n"), F.sum(VALUE).alias("v"),
        F.sum("margem_pct").alias("m"), F.count("margem_pct").alias("mn"))
    return (parts.join(F.broadcast(calendar.select("sk_tempo", "ano", "trimestre")), "sk_tempo")
            .groupBy("ano", "trimestre").agg(
                F.sum("n").alias("qtd_vendas"), F.sum("v").cast(TOTAL).alias("receita"),
                mean_of(F.sum("v"), F.sum("n")).alias("ticket_medio"),
                mean_of(F.sum("m"), F.sum("mn"), "decimal(10,2)").alias("margem_media_pct")))


def credit_by_segment(customers: DataFrame) -> DataFrame:
    return customers.groupBy("segmento_cliente").agg(
        F.count("limite_credito").alias("qtd"), mean("limite_credito").alias("media"),
        F.min("limite_credito").alias("minimo"), F.max("limite_credito").alias("maximo"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    by = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("qtd"))
    return share_of_total(by, "qtd", "pct", 1)


def melt(one: DataFrame, name: str, value: str) -> DataFrame:
    """A one-row frame as name/value rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in one.columns])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def quartiles(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact quartiles with linear interpolation, one row per column that has a value.

    Rows are counted per column and value first, so a value held by most rows is one row in the sort, and
    all columns share the pass, the sort and the running sum.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).cast("double").alias("v")) for c in cols]))
    counts = df.select(pairs.alias("p")).select("p.*").where("v IS NOT NULL").groupBy("coluna", "v").agg(F.count("*").alias("n"))
    run = running_sum(counts, [F.asc("coluna"), F.asc("v")], "n", "upto", "_all", "_pos")
    ends = run.groupBy("coluna").agg(F.min(F.col("upto") - F.col("n")).alias("base"), F.max("upto").alias("last"))
    run = run.join(F.broadcast(ends), "coluna").select(  # one row per column
        "coluna", "v", "n", (F.col("upto") - F.col("base")).alias("upto"), (F.col("last") - F.col("base")).alias("total"))
    at = {p: F.lit(q) * (F.col("total") - 1) for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}

    def value_at(row: Column) -> Column:
        return F.max(F.when((F.col("upto") > row) & (F.col("upto") - F.col("n") <= row), F.col("v")))

    return run.groupBy("coluna").agg(*[
        (value_at(F.floor(pos)) + (value_at(F.ceil(pos)) - value_at(F.floor(pos))) * F.max(pos - F.floor(pos)))
        .alias(p) for p, pos in at.items()])


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    one = df.agg(*[
        F.struct(
            F.count(c).alias("contagem"), F.avg(F.col(c).cast("double")).alias("media"),
            F.stddev_samp(c).alias("desvio"), F.min(c).cast("double").alias("minimo"),
            F.max(c).cast("double").alias("maximo"),
        ).alias(c) for c in cols])
    moments = melt(one, "coluna", "r").select("coluna", "r.*")
    return moments.join(quartiles(df, cols), "coluna", "left")


def profile_columns(df: DataFrame) -> DataFrame:
    """Type, nulls, percent of nulls and the smallest value as an example, one pass."""
    one = df.agg(F.count("*").alias("_n"), *[
        F.struct(
            F.lit(c).alias("coluna"), F.lit(t).alias("tipo"),
            F.count_if(F.col(c).isNull()).alias("nulos"), F.min(c).cast("string").alias("exemplo"),
        ).alias(c) for c, t in df.dtypes])
    rows = one.select("_n", F.explode(F.array(*df.columns)).alias("r")).select("_n", "r.*")
    return rows.select("coluna", "tipo", "nulos",
                       F.try_divide(F.col("nulos") * 100.0, "_n").alias("pct_nulos"), "exemplo")


def distinct_meta(df: DataFrame) -> DataFrame:
    """Distinct values of each metadata column, one row per column and value."""
    meta = [c for c in df.columns if c.startswith("_")]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("coluna"), F.col(c).cast("string").alias("valor")) for c in meta]))
    return df.select(pairs.alias("p")).select("p.*").distinct()


def revenue_of_day(mart: DataFrame, day: date) -> DataFrame:
    return mart.where(F.col("data_venda") == F.lit(day)).agg(F.sum("receita_total").cast(TOTAL).alias("receita"))


def hourly_volume(fact: DataFrame, day: date, ts: str = "data_venda") -> DataFrame:
    start = F.lit(day).cast("timestamp")
    kind = dict(fact.dtypes)[ts]
    inside = (F.col(ts) >= start.cast(kind)) & (F.col(ts) < F.date_add(F.lit(day), 1).cast(kind))
    return fact.where(inside).groupBy(F.hour(ts).alias("hora")).agg(F.count("*").alias("qtd"))


def load_counts(dim: DataFrame, fact: DataFrame, day: date) -> DataFrame:
    """Post-load counts: current customers, sales, and rows loaded for one day."""
    clients = dim.agg(F.count_if("registro_atual").alias("clientes_ativos"),
                      F.count_if(F.col("cpf").isNull()).alias("cpf_nulos"))
    facts = fact.agg(F.count("*").alias("vendas"),
                     F.count_if(F.to_date("data_venda") == F.lit(day)).alias("vendas_do_dia"),
                     F.count_if(F.col(VALUE) < 0).alias("valores_negativos"))
    return melt(clients, "medida", "valor").unionByName(melt(facts, "medida", "valor"))


def ranked_products(sales: DataFrame) -> DataFrame:
    return sales.groupBy("produto_id", "produto_nome").agg(
        F.sum("quantidade").alias("unidades"), total().alias("receita_total"),
        mean().alias("ticket_medio"))


def sales_by_uf(sales: DataFrame) -> DataFrame:
    return sales.groupBy("uf", "regiao").agg(
        F.count("*").alias("qtd_vendas"), F.countDistinct("cpf_cliente").alias("qtd_clientes"),
        total().alias("receita_total"), mean().alias("ticket_medio"))


def channel_performance(sales: DataFrame) -> DataFrame:
    by = sales.groupBy("canal_venda").agg(
        F.count("*").alias("qtd_vendas"), F.countDistinct("cpf_cliente").alias("qtd_clientes"),
        total().alias("receita_total"), mean().alias("ticket_medio"),
        F.count_if(F.col("status_venda") == "CANCELADA").alias("canceladas"))
    return share_of_total(by, "receita_total", "share_receita_pct")


def zone_stats(files: DataFrame, root_depth: int | None = None) -> DataFrame:
    """Objects and bytes per zone; the zone is the first path part, or the one after the root."""
    part = F.split("path", "/").getItem(root_depth or 0)
    return files.groupBy(part.alias("zona")).agg(
        F.count("*").alias("objetos"), F.sum("bytes").cast("bigint").alias("bytes"))


def heavy_hitters(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    by = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("qtd"))
    return by.orderBy(F.desc("qtd"), F.asc(col)).limit(n)


def dq_pass_rate(reports: DataFrame) -> DataFrame:
    return reports.groupBy("dia", "dataset").agg(
        F.avg(F.col("passou").cast("double")).alias("pass_rate"),
        F.count_if(~F.col("passou")).alias("checks_falhos"))
