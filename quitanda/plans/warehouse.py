"""Staging, dimensions and fact: DataFrame in, DataFrame out."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quitanda.functions.dates import age_band
from quitanda.functions.money import MONEY, margin_value
from quitanda.functions.text import region_of
from quitanda.operators import joins
from quitanda.operators.incremental import range_reload
from quitanda.operators.keyed import latest_per_key, minus_by_key
from quitanda.operators.quality import assert_none
from quitanda.operators.ranking import number_rows
from quitanda.operators.rows import changed, current_rows, in_range, positive, with_defaults
from quitanda.session import materialize

TRACKED = ("nome", "email", "cidade", "uf", "segmento_cliente")
SALE_DEFAULTS = {"quantidade": 1, "desconto": 0, "status_venda": "CONCLUIDA", "parcelas": 1}
_CUSTOMER = ("cpf", "nome", "email", "telefone", "data_nascimento", "data_cadastro_crm", "cidade",
             "uf", "cep", "regiao", "segmento_cliente", "faixa_etaria", "limite_credito")


def stage(df: DataFrame, loaded_at: Column, batch_id: str) -> DataFrame:
    return df.withColumns({"stg_load_timestamp": loaded_at, "stg_batch_id": F.lit(batch_id)})


def stage_customers(df: DataFrame, loaded_at: Column, batch_id: str, path: str) -> DataFrame:
    """Full refresh once the assertion holds: a null CPF is an error and leaves the old staging in place."""
    staged = materialize(stage(df, loaded_at, batch_id), "stg-clientes")
    assert_none(staged, F.col("cpf").isNull(), "staged customers without CPF")
    staged.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_sales(table: DataFrame, new: DataFrame, start: date, end: date, loaded_at: Column,
                batch_id: str, truncate: bool = False) -> DataFrame:
    """Replace the date range, or everything when ``truncate``."""
    fresh = stage(new, loaded_at, batch_id)
    return fresh if truncate else range_reload(table, fresh, "data_venda", start, end)


def sequence_keys(rows: DataFrame, dim: DataFrame, sk: str, order: list[str]) -> DataFrame:
    """Surrogate keys after the dimension's greatest, dense and in ``order``."""
    top = F.coalesce(dim.agg(F.max(sk)).scalar(), F.lit(0))
    return number_rows(rows, [F.asc(c) for c in order], sk, label=sk, start=top)


def _customer_version(stg: DataFrame, as_of: date) -> DataFrame:
    have = set(stg.columns)
    derived = {
        "data_cadastro_crm": F.col("data_cadastro") if "data_cadastro" in have else F.lit(None).cast("timestamp"),
        "regiao": region_of(F.col("uf")),
        "faixa_etaria": (age_band(F.col("data_nascimento"), F.lit(as_of)) if "data_nascimento" in have
                         else F.lit(None).cast("string")),
    }
    return stg.withColumns(derived)


def scd2_customers(dim: DataFrame, stg: DataFrame, as_of: date) -> DataFrame:
    """Type-2 customer dimension after one load.

    A change in a tracked column closes the current version the day before ``as_of`` and opens a
    new one; a second change on the day a version was opened replaces that version instead. Other
    columns never open a version. Loading the same staging twice changes nothing.
    """
    attrs = [c for c in _CUSTOMER if c in dim.columns]
    # Written once: it is joined twice, and a table of known size lets Spark broadcast a small load.
    newest = materialize(
        _customer_version(latest_per_key(stg, ["cpf"], ["data_cadastro"]), as_of).select(*attrs), "clientes-novos")
    current = current_rows(dim)

    pair = current.alias("d").join(newest.alias("s"), F.col("d.cpf") == F.col("s.cpf"), "left")
    differs = F.col("s.cpf").isNotNull() & changed("d", "s", [c for c in TRACKED if c in attrs])
    today = F.col("d.data_inicio_vigencia") == F.lit(as_of)
    close, replace = differs & ~today, differs & today
    values = {c: F.col(f"d.{c}") for c in dim.columns}
    values |= {c: F.when(replace, F.col(f"s.{c}")).otherwise(F.col(f"d.{c}")) for c in attrs}
    values["data_fim_vigencia"] = F.when(close, F.lit(as_of - timedelta(days=1))).otherwise(F.col("d.data_fim_vigencia"))
    values["registro_atual"] = ~close
    kept = pair.select(*[v.alias(c) for c, v in values.items()])

    opened = minus_by_key(newest, current_rows(kept), ["cpf"]).withColumns({
        "data_inicio_vigencia": F.lit(as_of), "data_fim_vigencia": F.lit(None).cast("date"),
        "registro_atual": F.lit(True),
    })
    opened = sequence_keys(opened, dim, "sk_cliente", ["cpf"])
    history = dim.where(~F.col("registro_atual"))
    return history.unionByName(kept).unionByName(opened, allowMissingColumns=True)


def empty_customer_dim(stg: DataFrame, as_of: date) -> DataFrame:
    """Dimension without rows, typed after the staging table."""
    attrs = [c for c in _CUSTOMER if c in _customer_version(stg, as_of).columns]
    return _customer_version(stg, as_of).where(F.lit(False)).select(
        F.lit(0).cast("bigint").alias("sk_cliente"), *attrs,
        F.lit(as_of).alias("data_inicio_vigencia"), F.lit(None).cast("date").alias("data_fim_vigencia"),
        F.lit(True).alias("registro_atual"))


def load_products(dim: DataFrame, stg: DataFrame, as_of: date) -> DataFrame:
    """Insert products that are not in the dimension; no updates.

    One row per ``produto_id``: of several spellings the one of the latest sale is taken, for two
    current rows of one product would double its sales in the fact.
    """
    when = ["data_venda"] if "data_venda" in stg.columns else []
    sold = (stg.where(F.col("produto_id").isNotNull())
            .select("produto_id", "produto_nome", F.col("categoria_produto").alias("categoria"), *when))
    newest = latest_per_key(sold, ["produto_id"], when).drop(*when)
    fresh = minus_by_key(newest, current_rows(dim), ["produto_id"]).withColumns({
        "data_inicio_vigencia": F.lit(as_of), "data_fim_vigencia": F.lit(None).cast("date"),
        "registro_atual": F.lit(True)})
    keyed = sequence_keys(fresh, dim, "sk_produto", ["produto_id", "produto_nome", "categoria"])
    return dim.unionByName(keyed, allowMissingColumns=True)


def empty_product_dim(stg: DataFrame, as_of: date) -> DataFrame:
    return stg.where(F.lit(False)).select(
        F.lit(0).cast("bigint").alias("sk_produto"), "produto_id", "produto_nome",
        F.col("categoria_produto").alias("categoria"), F.lit(as_of).alias("data_inicio_vigencia"),
        F.lit(None).cast("date").alias("data_fim_vigencia"), F.lit(True).alias("registro_atual"))


def fact_rows(stg: DataFrame, customers: DataFrame, products: DataFrame, calendar: DataFrame,
              start: date, end: date, loaded_at: Column, batch_id: str) -> DataFrame:
    """Fact rows of a closed date range: known customer, known day, product if known."""
    sold = positive(in_range(stg, "data_venda", start, end), "valor_total")
    defaults = {c: v for c, v in SALE_DEFAULTS.items() if c in sold.columns}
    priced = with_defaults(sold, defaults)
    keyed = joins.lookup_date(joins.lookup_product(joins.lookup_customer(priced, customers), products), calendar)
    if "custo" in keyed.columns:
        keyed = keyed.withColumn("margem_valor", margin_value(F.col("valor_total"), F.col("custo")).cast(MONEY))
    return (keyed.withColumns({"dw_criado_em": loaded_at, "dw_batch_id": F.lit(batch_id)})
            .drop("cpf_cliente", "produto_id", "produto_nome", "categoria_produto"))


def orphan_count(stg: DataFrame, customers: DataFrame, start: date, end: date) -> DataFrame:
    return joins.orphan_sales(in_range(stg, "data_venda", start, end), customers).agg(
        F.count("*").alias("sem_cliente"))
