"""The given tables in the shapes the library works on."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quitanda.functions.dates import date_key
from quitanda.functions.money import MONEY, margin_pct, value_band
from quitanda.functions.text import STATES, region_of
from quitanda.plans.calendar import calendar, days_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coded(c: Column, values: dict[str, str], other: str) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(15,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def sale_columns() -> dict[str, tuple[Column, tuple[str, ...]]]:
    """Column -> (expression, tables it needs besides lineitem)."""
    # Whole cents and percents: amounts are two-decimal doubles in the files.
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    off = F.round(F.col("l_discount") * 100).cast("bigint")
    retail = F.round(F.col("p_retailprice") * 100).cast("bigint")
    value = _money(F.call_function("div", price * (100 - off) + 50, F.lit(100)))
    discount = _money(F.call_function("div", price * off + 50, F.lit(100)))
    cost = _money(F.call_function("div", F.col("l_quantity").cast("bigint") * retail * 55 + 50, F.lit(100)))
    order, part, customer = ("orders",), ("part",), ("orders", "customer")
    channel = {"1-URGENT": "ECOMMERCE", "2-HIGH": "APP_MOBILE", "3-MEDIUM": "TELEVENDAS"}
    return {
        "id_pedido": (F.col("l_orderkey"), ()),
        "produto_id": (F.col("l_partkey"), ()),
        "data_entrega": (F.col("l_shipdate"), ()),
        "quantidade": (F.col("l_quantity").cast("int"), ()),
        "valor_total": (value, ()),
        "desconto": (discount, ()),
        "forma_pagamento": (coded(F.col("l_linestatus"), {"O": "PIX"}, "BOLETO"), ()),
        "status_venda": (coded(F.col("l_returnflag"), {"R": "CANCELADA", "A": "DEVOLVIDA"}, "CONCLUIDA"), ()),
        "cpf_cliente": (F.col("o_custkey").cast("string"), order),
        "sk_cliente": (F.col("o_custkey"), order),
        "data_venda": (F.col("o_orderdate"), order),
        "sk_tempo": (date_key(F.col("o_orderdate")), order),
        "canal_venda": (coded(F.col("o_orderpriority"), channel, "LOJA_FISICA"), order),
        "produto_nome": (F.col("p_name"), part),
        "categoria_produto": (F.col("p_type"), part),
        "custo": (cost, part),
        "segmento_cliente": (F.col("c_mktsegment"), customer),
        "nome": (F.col("c_name"), customer),
        "uf": (F.col("n_name"), (*customer, "nation")),
        "regiao": (F.col("r_name"), (*customer, "nation", "region")),
    }


# Derived from other sale columns in a second step, so those are computed once.
DERIVED = {"margem_pct": ("valor_total", "custo"), "categoria_valor": ("valor_total",)}


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per order line with the wanted columns; only the tables they need are joined."""
    known = sale_columns()
    base = list(dict.fromkeys(b for c in columns for b in DERIVED.get(c, (c,))))
    need = {t for c in base for t in known[c][1]}
    df = table(spark, sf_dir, "lineitem")
    on = {
        "part": F.col("l_partkey") == F.col("p_partkey"),
        "orders": F.col("l_orderkey") == F.col("o_orderkey"),
        "customer": F.col("o_custkey") == F.col("c_custkey"),
        "nation": F.col("c_nationkey") == F.col("n_nationkey"),
        "region": F.col("n_regionkey") == F.col("r_regionkey"),
    }
    for name, condition in on.items():
        if name in need:
            df = df.join(table(spark, sf_dir, name), condition)
    df = df.select(*[known[c][0].alias(c) for c in base])
    derived = {"margem_pct": margin_pct(F.col("valor_total"), F.col("custo")),
               "categoria_valor": value_band(F.col("valor_total"))}
    return df.select(*[derived[c].alias(c) if c in derived else c for c in columns])


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar over the days of the orders."""
    return calendar(days_of(table(spark, sf_dir, "orders"), "o_orderdate"))


def star_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer dimension of the test star: one current version per customer."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("sk_cliente"), F.col("c_custkey").cast("string").alias("cpf"),
                    F.col("c_name").alias("nome"),
                    F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@exemplo.com")).alias("email"),
                    F.col("n_name").alias("uf"), F.col("r_name").alias("regiao"),
                    F.col("c_mktsegment").alias("segmento_cliente"), F.lit(True).alias("registro_atual")))


FACT = ("sk_cliente", "sk_tempo", "data_venda", "valor_total", "desconto", "custo", "margem_pct",
        "canal_venda", "forma_pagamento", "status_venda")


def fact(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return sales(spark, sf_dir, *(columns or FACT))


def cpf_text(key: Column) -> Column:
    return F.lpad(key.cast("string"), 11, "0")


def state_of(key: Column) -> Column:
    """One of the 27 states by number."""
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), (key % 27 + 1).cast("int"))


def staged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as staged on the first day."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        cpf_text(k).alias("cpf"), F.col("c_name").alias("nome"),
        F.concat(F.lit("c"), k.cast("string"), F.lit("@exemplo.com")).alias("email"),
        F.concat(F.lit("Cidade "), F.col("c_nationkey").cast("string")).alias("cidade"),
        state_of(F.col("c_nationkey")).alias("uf"), F.col("c_mktsegment").alias("segmento_cliente"),
        F.col("c_acctbal").cast(MONEY).alias("limite_credito"),
        F.lit("1996-01-01 00:00:00").cast("timestamp").alias("data_cadastro"))


def restaged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second day: some segments changed, some limits (not tracked), some names lost, some
    customers new."""
    k = F.col("cpf").cast("bigint")
    first = staged_customers(spark, sf_dir)
    second = first.withColumns({
        "segmento_cliente": F.when(k % 10 == 0, "B2B").otherwise(F.col("segmento_cliente")),
        "limite_credito": F.when(k % 7 == 1, F.lit(0).cast(MONEY)).otherwise(F.col("limite_credito")),
        "nome": F.when(k % 30 != 4, F.col("nome")),
    })
    fresh = first.where(k % 20 == 3).withColumn("cpf", cpf_text(k + 90_000_000_000))
    return second.unionByName(fresh)


def with_region(df: DataFrame) -> DataFrame:
    return df.withColumn("regiao", region_of(F.col("uf")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    """Raw events, batch or stream, in the website event shape."""
    kind = coded(F.col("event_type"), {"purchase": "PURCHASE_COMPLETED", "view": "PRODUCT_VIEW",
                                       "click": "BUTTON_CLICK"}, "PAGE_VIEW")
    product = F.concat(F.lit("P"), F.get_json_object("props", "$.k"))
    return raw.select(
        F.col("event_id").cast("string").alias("_id"), kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"), "user_id",
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("value").cast(MONEY).alias("valor_total"),
        F.when(F.col("event_type") != "purchase", product).alias("propriedade_produto"),
        F.when(F.col("event_type") == "purchase", product).alias("produto_comprado"))
