"""Schema discovery from object keys and text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quitanda.functions.money import parse_money
from quitanda.sources.files import list_objects

_TESTS = {
    "bigint": lambda c: c.rlike(r"^\s*[+-]?\d+\s*$") & c.try_cast("bigint").isNotNull(),
    "double": lambda c: parse_money(F.regexp_replace(c, r"^\s*[+-]", "")).isNotNull(),
    "timestamp": lambda c: c.rlike(r"^\s*\d{4}-\d{1,2}") & c.try_cast("timestamp").isNotNull(),
}


def table_name(key: Column) -> Column:
    """Folder parts that are not ``k=v``, joined by underscores."""
    folders = F.slice(F.split(key, "/"), 1, F.size(F.split(key, "/")) - 1)
    kept = F.filter(folders, lambda p: ~p.contains("="))
    return F.replace(F.array_join(kept, "_"), F.lit("-"), F.lit("_"))


def base_location(key: Column) -> Column:
    """Folder before the first partition part."""
    return F.regexp_replace(F.regexp_replace(key, r"[^/]*$", ""), r"(^|/)[^/]*=.*$", "$1")


def partition_keys(objects: DataFrame, key: str = "key") -> DataFrame:
    """Hive partition keys of each table with their depth."""
    names = F.regexp_extract_all(F.col(key), F.lit(r"([^/=]+)=[^/]*/"), 1)
    return (objects.select(table_name(F.col(key)).alias("tabela"), F.posexplode(names).alias("nivel", "coluna"))
            .groupBy("tabela", "nivel", "coluna").agg(F.count("*").alias("objetos")))


def infer_types(df: DataFrame) -> DataFrame:
    """Narrowest type every value of a text column fits, from all rows in one pass."""
    text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in df.columns}
    one = df.agg(*[
        F.struct(F.lit(c).alias("coluna"), F.count(t).alias("n"),
                 *[F.count_if(test(t)).alias(k) for k, test in _TESTS.items()]).alias(c)
        for c, t in text.items()])
    rows = one.select(F.explode(F.array(*df.columns)).alias("r")).select("r.*")
    kind = F.when(F.col("n") == 0, "string")
    for k in _TESTS:
        kind = kind.when(F.col(k) == F.col("n"), k)
    return rows.select("coluna", kind.otherwise("string").alias("tipo"))


def columns_of(spark: SparkSession, path: str, fmt: str, **options) -> list[tuple[str, str]]:
    """Column names and types of a file set; Parquet answers from its footers."""
    return spark.read.options(**options).format(fmt).load(path).dtypes


def merge_schemas(columns: DataFrame) -> DataFrame:
    """Union of columns over files (tabela, coluna, tipo): string wins, then double, else the
    one type there is, else the first by name."""
    types = F.collect_set("tipo")  # a handful of type names per column
    return columns.groupBy("tabela", "coluna").agg(types.alias("t")).select(
        "tabela", "coluna",
        F.when(F.array_contains("t", "string"), "string")
         .when(F.array_contains("t", "double"), "double")
         .otherwise(F.array_min("t")).alias("tipo"))


def crawl(objects: DataFrame, key: str = "key") -> DataFrame:
    """Tables found under the objects: location, format, partition keys, files and bytes."""
    k = F.col(key)
    parts = F.array_join(F.regexp_extract_all(k, F.lit(r"([^/=]+)=[^/]*/"), 1), ",")
    return objects.groupBy(table_name(k).alias("tabela")).agg(
        F.min(base_location(k)).alias("localizacao"),
        F.min(F.regexp_extract(k, r"\.([A-Za-z0-9]+)$", 1)).alias("formato"),
        F.max(parts).alias("particoes"),
        F.count("*").alias("arquivos"), F.sum("bytes").cast("bigint").alias("bytes"))


def crawl_columns(spark: SparkSession, root: str) -> DataFrame:
    """Columns and types of every table found under ``root``: (tabela, formato, coluna, tipo).

    Parquet answers from its footers; text formats get the narrowest type that all of their values
    fit, partition keys included. What reaches the driver is one row per table.
    """
    base = root.rstrip("/") + "/"
    local = re.sub("^[a-z0-9]+:/*", "/", base)  # listings spell the scheme in their own way
    listed = list_objects(spark, root).where(~F.col("path").rlike(r"/[._][^/]*$"))
    short = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    key = F.replace(short, F.lit(local), F.lit(""))
    found = crawl(listed.select(key.alias("key"), "bytes")).select("tabela", "localizacao", "formato").collect()
    out = None
    for t in found:
        place = f"{base}{t.localizacao}"
        if t.formato == "parquet":
            cols = spark.createDataFrame(columns_of(spark, place, "parquet"), "coluna string, tipo string")
        elif t.formato == "csv":
            cols = infer_types(spark.read.option("header", True).csv(place))
        elif t.formato == "json":
            cols = infer_types(spark.read.option("primitivesAsString", True).json(place))
        else:
            continue
        one = cols.select(F.lit(t.tabela).alias("tabela"), F.lit(t.formato).alias("formato"), "coluna", "tipo")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "tabela string, formato string, coluna string, tipo string")
