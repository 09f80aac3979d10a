"""Batch readers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quitanda import schemas
from quitanda.operators.keyed import latest_per_key
from quitanda.operators.rows import in_range, select_existing
from quitanda.sources.documents import list_records
from quitanda.sources.sinks import exists

LARGE_DOCUMENT = 16 << 20  # bytes; a larger document is read block by block, by many tasks


def with_source(df: DataFrame, ingested_at: Column) -> DataFrame:
    return df.withColumns({
        "_source_file": F.col("_metadata.file_path"),
        "_ingestion_timestamp": ingested_at,
    })


def landed_folders(spark: SparkSession, path: str, first: date, last: date) -> list[str]:
    """The ``ano=/mes=/dia=`` folders of the landing days ``first``..``last`` that exist; no other folder is listed."""
    days = (first + timedelta(days=i) for i in range((last - first).days + 1))
    folders = [f"{path}/ano={d.year}/mes={d.month:02d}/dia={d.day:02d}" for d in days]
    return [f for f in folders if exists(spark, f)]


def landing_day(source_file: Column) -> Column:
    """The landing day in a file's path; null where it has none."""
    day = F.regexp_extract(source_file, "/ano=(\\d{4})/mes=(\\d{2})/dia=(\\d{2})/", 0)
    return F.when(day != "", F.to_date(F.regexp_replace(day, "[^0-9]", ""), "yyyyMMdd"))


def landed_between(source_file: Column, first: date, last: date) -> Column:
    """Whether a file landed ``first``..``last``; false without a landing day.

    Up to a month is looked up as plain text first, so that the pattern meets only paths that name one of its days.
    """
    day = landing_day(source_file)
    exact = F.coalesce(day.between(first, last), F.lit(False))
    if (last - first).days > 30:
        return exact
    named = F.lit(False)
    for d in (first + timedelta(days=i) for i in range((last - first).days + 1)):
        named = named | F.coalesce(source_file.contains(f"/ano={d.year:04d}/mes={d.month:02d}/dia={d.day:02d}/"), F.lit(False))
    return named & exact


def customer_documents(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Customer JSON documents as read, with ``_corrupt_record`` for the malformed ones."""
    return (spark.read.schema(schemas.customer_document())
            .option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("recursiveFileLookup", True)
            .json(path))


def _large(spark: SparkSession, path: str | list[str], bytes_: int) -> bool:
    """Whether any document is larger; from the listing, contents are not read."""
    return not list_objects(spark, path).where(F.col("bytes") > bytes_).isEmpty()


def customers_json(spark: SparkSession, path: str | list[str], ingested_at: Column,
                   multi_line: bool = True, large: int = LARGE_DOCUMENT) -> DataFrame:
    """One row per customer from a list, ``{clientes: [...]}``, ``{data: [...]}`` or one object.

    With ``multi_line`` a file is one document. Documents of over ``large`` bytes must hold a list, of
    which malformed members are left out one by one.
    """
    docs = with_source(customer_documents(spark, path, multi_line), ingested_at)
    names = schemas.struct(schemas.CUSTOMER).names
    flat = F.struct(*names)
    rows = F.coalesce(F.col("clientes"), F.col("data"), F.array(flat))

    def customers(docs: DataFrame) -> DataFrame:
        return (docs.where(F.col("_corrupt_record").isNull())
                .select(F.explode(rows).alias("c"), "_source_file", "_ingestion_timestamp")
                .select("c.*", "_source_file", "_ingestion_timestamp"))

    if not multi_line or not _large(spark, path, large):
        return customers(docs)
    kind = schemas.struct(schemas.CUSTOMER).add("_corrupt_record", "string")
    one = F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt_record"})
    found = (list_records(spark, path, ("clientes", "data"), large).where("NOT unreadable")
             .select(one.alias("c"), "_source_file").where(F.col("c._corrupt_record").isNull())
             .select(*[f"c.{n}" for n in names], "_source_file", ingested_at.alias("_ingestion_timestamp")))
    return customers(docs.where(F.col("_metadata.file_size") <= large)).unionByName(found)


def first_list_json(spark: SparkSession, path: str, ddl: str, multi_line: bool = True,
                    large: int = LARGE_DOCUMENT) -> DataFrame:
    """Records of the first list found in each JSON document, whatever its key; a bare list too.

    Documents without a list and malformed ones give no row. Documents of over ``large`` bytes are
    read block by block.
    """
    doc = F.trim("value")
    fields = F.map_values(F.from_json(doc, "map<string,string>"))
    found = F.when(doc.startswith("["), doc).otherwise(F.get(F.filter(fields, lambda v: v.startswith("[")), 0))
    lines = spark.read.text(path, wholetext=multi_line, recursiveFileLookup=True)

    def members(lines: DataFrame) -> DataFrame:
        return lines.select(F.explode(F.from_json(found, f"array<struct<{ddl}>>")).alias("c")).select("c.*")

    if not multi_line or not _large(spark, path, large):
        return members(lines)
    read = list_records(spark, path, over=large).where("NOT unreadable").select(F.from_json("value", f"struct<{ddl}>").alias("c"))
    return members(lines.where(F.col("_metadata.file_size") <= large)).unionByName(read.select("c.*"))


def processed_customers(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """Join columns of the processed customers, one row per CPF unless the caller dedups itself."""
    cols = ("cpf", "nome", "email", "uf", "cidade", "segmento_cliente")
    found = select_existing(spark.read.parquet(path), cols)
    return latest_per_key(found, ["cpf"], []) if unique else found


def processed_sales(spark: SparkSession, path: str, month_of: date | None = None,
                    only_day: bool = False) -> DataFrame:
    """Processed sales, all or the month partition of one date (optionally just that day)."""
    sales = spark.read.parquet(path)
    if month_of is None:
        return sales
    sales = sales.where((F.col("ano") == str(month_of.year)) & (F.col("mes") == f"{month_of.month:02d}"))
    if only_day:
        start = F.lit(month_of).cast("timestamp")
        sales = sales.where((F.col("data_venda") >= start)
                            & (F.col("data_venda") < start + F.expr("INTERVAL 1 DAY")))
    return sales


def sales_between(spark: SparkSession, path: str, start: date, end: date) -> DataFrame:
    """Processed sales of a closed date range: month partitions pruned, then the exact days."""
    month = F.concat("ano", "mes")
    return in_range(spark.read.parquet(path).where(month.between(f"{start:%Y%m}", f"{end:%Y%m}")),
                    "data_venda", start, end)


def events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.struct(schemas.EVENT)).option("recursiveFileLookup", True).json(path)


def catalog_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    """Full-refresh product catalogue."""
    return spark.read.schema(schemas.all_strings(columns)).option("header", True).csv(path)


def landed_jsonl(spark: SparkSession, path: str, ddl: str, cursor: str, last: str | None) -> DataFrame:
    """Pages landed by an API pull, newer than the saved cursor."""
    rows = spark.read.schema(ddl).json(path)
    return rows if last is None else rows.where(F.col(cursor) > last)


def list_objects(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes and modification time of every object; contents are not read."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .load(path)
            .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))


def raw_query(spark: SparkSession, table: DataFrame, name: str, sql: str) -> DataFrame:
    """Ad-hoc SQL over a raw or processed table under a view name."""
    table.createOrReplaceTempView(name)
    return spark.sql(sql)
