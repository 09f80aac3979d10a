"""Lookups between sales and dimensions.

No size-blind broadcast: Spark broadcasts a side only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold``; otherwise it sort-merges and AQE splits hot keys. The
calendar is the exception: one row per day is a proven bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quitanda.functions.dates import date_key
from quitanda.functions.text import digits
from quitanda.operators.keyed import latest_per_key, minus_by_key
from quitanda.operators.rows import current_rows
from quitanda.session import materialize


def unique_customers(customers: DataFrame) -> DataFrame:
    """One row per digits of the CPF, written to the shared folder: a join then reads a table of known
    size (broadcast only below the threshold), and with no aggregate under the join AQE can split
    a CPF that holds much of the sales.
    """
    known = customers.withColumn("cpf", digits(F.col("cpf").cast("string"))).where("cpf is not null")
    return materialize(latest_per_key(known, ["cpf"], []), "clientes-unicos")


def enrich_sales(sales: DataFrame, customers: DataFrame, unique: bool = False) -> DataFrame:
    """LEFT JOIN customers on the digits of the CPF; customers made unique first, unless they are."""
    key = "cpf_cliente" if "cpf_cliente" in sales.columns else "cpf"
    unique = customers if unique else unique_customers(customers)
    clean = sales.withColumn(key, digits(F.col(key).cast("string")))
    return clean.join(unique.withColumnRenamed("cpf", key), key, "left")


def lookup_customer(stg: DataFrame, dim: DataFrame) -> DataFrame:
    """INNER JOIN the current customer version."""
    current = current_rows(dim).select("sk_cliente", F.col("cpf").alias("cpf_cliente"))
    return stg.join(current, "cpf_cliente")


def lookup_product(stg: DataFrame, dim: DataFrame) -> DataFrame:
    """LEFT JOIN the current product: sales without one stay."""
    return stg.join(current_rows(dim).select("sk_produto", "produto_id"), "produto_id", "left")


def lookup_date(stg: DataFrame, calendar: DataFrame, day: str = "data_venda") -> DataFrame:
    """INNER JOIN the calendar on the computed YYYYMMDD key."""
    keyed = stg.withColumn("sk_tempo", date_key(F.col(day)))
    return keyed.join(F.broadcast(calendar.select("sk_tempo")), "sk_tempo")


def new_customers(stg: DataFrame, dim: DataFrame) -> DataFrame:
    return minus_by_key(stg, current_rows(dim), ["cpf"])


def new_products(stg: DataFrame, dim: DataFrame) -> DataFrame:
    return minus_by_key(stg, current_rows(dim), ["produto_id"])


def orphan_sales(stg: DataFrame, dim: DataFrame) -> DataFrame:
    """Sales whose customer has no current row (a null CPF is an orphan too)."""
    known = current_rows(dim).select(F.col("cpf").alias("cpf_cliente"))
    return stg.join(known, "cpf_cliente", "left_anti")


def star(fact: DataFrame, calendar: DataFrame, customers: DataFrame,
         calendar_cols: list[str], customer_cols: list[str]) -> DataFrame:
    """Fact with calendar and customer attributes by surrogate key."""
    return (fact.join(F.broadcast(calendar.select("sk_tempo", *calendar_cols)), "sk_tempo")
            .join(customers.select("sk_cliente", *customer_cols), "sk_cliente"))


def fact_current_customer(fact: DataFrame, dim: DataFrame, cols: list[str]) -> DataFrame:
    """Fact rows bound to a version that is still current."""
    return fact.join(current_rows(dim).select("sk_cliente", *cols), "sk_cliente")


def match_rate(df: DataFrame, col: str) -> DataFrame:
    n = F.count("*")
    hit = F.count(col)
    return df.agg(
        n.alias("total"), hit.alias("com_cliente"), (n - hit).alias("sem_cliente"),
        F.try_divide(hit * 100.0, n).alias("pct"),
    )


def as_of_dim(fact: DataFrame, dim: DataFrame, key: str, day: str, how: str = "left") -> DataFrame:
    """Dimension version valid on the fact's date: equi join on the key, range as residual."""
    d = dim.select(*[F.col(c).alias(f"_d_{c}") for c in dim.columns])
    on = ((F.col(key) == F.col(f"_d_{key}"))
          & (F.col(day) >= F.col("_d_data_inicio_vigencia"))
          & (F.col(day) <= F.coalesce(F.col("_d_data_fim_vigencia"), F.lit("9999-12-31").cast("date"))))
    taken = [c for c in dim.columns if c not in fact.columns]
    return fact.join(d, on, how).select(*fact.columns, *[F.col(f"_d_{c}").alias(c) for c in taken])
