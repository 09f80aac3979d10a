"""Batch writers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from quitanda.functions.dates import two_digits
from quitanda.session import many_files

SLICES = 1024  # of the values of partition columns, before small ones are put together


def by_folder(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out for a write into folders by ``by``.

    Spark cuts a slice that is too large by its input tasks, so every part of it holds all folders of the
    slice. With few slices a folder would get as many files as there are parts; with many, only a folder
    that is large itself is cut, and small ones share a task.
    """
    return df.hint("rebalance", SLICES, *by)


def write_partitioned(df: DataFrame, path: str, by: list[str], *,
                      rows_per_file: int = 0, mode: str = "overwrite", whole: bool = False) -> None:
    """Parquet by partition column; only the partitions present in ``df`` are replaced, or all if ``whole``.

    Rows are rebalanced on the partition columns, so small values share a task and AQE splits
    a value that holds much of the data.
    """
    with many_files(df.sparkSession):
        (by_folder(df, *by)
           .write.mode(mode).option("partitionOverwriteMode", "static" if whole else "dynamic")
           .option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path))


def _folder(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    root, fs = _folder(spark, path)
    return fs.exists(root)


def remove_folder(spark: SparkSession, path: str) -> None:
    root, fs = _folder(spark, path)
    fs.delete(root, True)


def _remove_partitions(spark: SparkSession, path: str, names: set[str]) -> None:
    root, fs = _folder(spark, path)
    for found in fs.listStatus(root):
        if found.getPath().getName() in names:
            fs.delete(found.getPath(), True)


def replace_days(df: DataFrame, path: str, day: str, start: date, end: date, partition: str = "dia") -> DataFrame:
    """Replace the days ``start``..``end`` of a dataset partitioned by day; the rest is not touched.

    Days with rows are overwritten, days of the range that got none are removed. Gives back the
    dataset. Nothing outside the range is read or rewritten, whatever the size of the history.
    """
    written = Observation()
    dated = by_folder(df.withColumn(partition, F.to_date(day)), partition)
    dated = dated.observe(written, F.collect_set(partition).alias("dias"))  # at most the days of the range
    with many_files(df.sparkSession):
        (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition).parquet(path))
    days = {start + timedelta(days=i) for i in range((end - start).days + 1)}
    if gone := days - set(written.get["dias"]):
        _remove_partitions(df.sparkSession, path, {f"{partition}={d}" for d in gone})
    return df.sparkSession.read.schema(dated.schema).parquet(path)


def replace_days_in_months(df: DataFrame, path: str, day: str, start: date, end: date, partition: str = "ano_mes") -> DataFrame:
    """``replace_days`` for a table of few rows a day, kept by month: a folder a day would take longer to make than its rows.

    The other days of the first and the last month are read and written again; no other month is touched.
    """
    spark = df.sparkSession
    dated = df.withColumn(partition, (F.year(day) * 100 + F.month(day)).cast("int"))
    months = {d.year * 100 + d.month for d in (start + timedelta(days=i) for i in range((end - start).days + 1))}
    rows = dated
    if exists(spark, path):
        kept = spark.read.schema(dated.schema).parquet(path).where(F.col(partition).between(min(months), max(months)))
        rows = dated.unionByName(kept.where(~F.to_date(day).between(start, end)))
    replace_partitions(rows, path, [partition], {(m,) for m in months})
    return spark.read.schema(dated.schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str], touched: set[tuple]) -> None:
    """Write the partitions of ``df`` over those in place; ``touched`` ones that ``df`` has no rows for are removed.

    ``df`` may read the partitions it replaces: files are exchanged when all of them are written.
    """
    written = Observation()
    # after the rows are dealt out: AQE takes everything below away if there are none
    dealt = by_folder(df, *by).observe(written, F.collect_set(F.struct(*by)).alias("keys"))  # at most those touched
    with many_files(df.sparkSession):
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    name = lambda c, v: f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}"
    for gone in touched - {tuple(k) for k in written.get["keys"]}:
        remove_folder(df.sparkSession, "/".join([path, *(name(c, v) for c, v in zip(by, gone))]))


def _partitions(fs, folder, depth: int, name: str = ""):
    """(``a=../b=..``, folder) of the partitions ``depth`` columns deep."""
    if not depth:
        yield name, folder
        return
    for found in fs.listStatus(folder):
        last = found.getPath().getName()
        if found.isDirectory() and "=" in last:
            yield from _partitions(fs, found.getPath(), depth - 1, f"{name}/{last}" if name else last)


def has_partitions(spark: SparkSession, path: str) -> bool:
    root, fs = _folder(spark, path)
    return fs.exists(root) and any(True for _ in _partitions(fs, root, 1))


def exchange_partitions(spark: SparkSession, folders: list[str], path: str, by: list[str], touched: set[tuple] = frozenset()) -> None:
    """The partitions written in ``folders``, on the file system of ``path``, take the place of those in ``path``;
    ``touched`` ones that are in none of them are removed. Files are moved, not read; a partition may be in many folders."""
    root, fs = _folder(spark, path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    name = lambda c, v: f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}"
    fresh = {}
    for folder in folders:
        for found, where in _partitions(fs, at(folder), len(by)) if exists(spark, folder) else ():
            fresh.setdefault(found, []).append(where)
    for gone in {"/".join(name(c, v) for c, v in zip(by, t)) for t in touched} - fresh.keys():
        fs.delete(at(root, gone), True)
    for found, parts in fresh.items():
        goal = at(root, found)
        fs.delete(goal, True)
        fs.mkdirs(goal.getParent())
        if not fs.rename(parts[0], goal):
            raise OSError(f"{parts[0]} not moved to {goal}")
        for part in parts[1:]:
            for file in fs.listStatus(part):
                if not fs.rename(file.getPath(), at(goal, file.getPath().getName())):
                    raise OSError(f"{file.getPath()} not moved to {goal}")
    fs.create(at(root, "_SUCCESS"), True).close()


def expire_months(spark: SparkSession, path: str, ts: str, cut: date) -> list[str]:
    """Remove the rows before ``cut`` from a dataset by ``ano=/mes=``; gives the folders removed.

    Months wholly before it go as folders, unread; of the month it lies in, the rows left are written
    anew if any is older. Other months, and rows without a month, are not touched.
    """
    root, fs = _folder(spark, path)
    removed = []
    for year in fs.listStatus(root):
        if year.getPath().getName()[:4] != "ano=":
            continue
        for month in fs.listStatus(year.getPath()):
            at = (year.getPath().getName()[4:], month.getPath().getName()[4:])
            if all(v.isdigit() for v in at) and tuple(map(int, at)) < (cut.year, cut.month):
                fs.delete(month.getPath(), True)
                removed.append(f"ano={at[0]}/mes={at[1]}")
    at = (str(cut.year), f"{cut.month:02d}")
    if exists(spark, f"{path}/ano={at[0]}/mes={at[1]}"):
        month = spark.read.parquet(path).where((F.col("ano") == at[0]) & (F.col("mes") == at[1]))
        limit = F.lit(cut).cast(dict(month.dtypes)[ts])
        if not month.where(F.col(ts) < limit).isEmpty():
            replace_partitions(month.where(F.col(ts).isNull() | (F.col(ts) >= limit)), path, ["ano", "mes"], {at})
    return sorted(removed)


def write_customers(df: DataFrame, path: str) -> None:
    """The full set of customers: a customer who moved leaves no row in the old state."""
    write_partitioned(df, path, ["uf"], whole=True)


def with_year_month(df: DataFrame, day: str = "data_venda") -> DataFrame:
    return df.withColumns({"ano": F.year(day).cast("string"), "mes": two_digits(F.month(day))})


def write_sales(df: DataFrame, path: str) -> None:
    write_partitioned(with_year_month(df), path, ["ano", "mes"])


def write_aggregate(df: DataFrame, path: str, as_of: Column) -> None:
    """Aggregates as JSON records under the reference date; a rerun replaces that date."""
    (df.withColumn("data_ref", as_of.cast("string"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("data_ref").json(path))


def land_raw(df: DataFrame, path: str, day: Column, batch: str, compression: str = "gzip") -> None:
    """Compressed JSON lines under ``ano=/mes=/dia=/lote=``; a rerun of the batch replaces its folders."""
    (df.withColumns({"ano": F.year(day).cast("string"), "mes": two_digits(F.month(day)),
                     "dia": two_digits(F.dayofmonth(day)), "lote": F.lit(batch)})
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression)
       .partitionBy("ano", "mes", "dia", "lote").json(path))


def write_batch(df: DataFrame, path: str, batch: str, fmt: str = "json") -> None:
    """One batch of a growing dataset in its own ``lote=`` folder; a rerun replaces that folder."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").format(fmt).save(f"{path}/lote={batch}")


def quarantine(df: DataFrame, path: str, batch: str, errors: str = "erros") -> DataFrame:
    """Write rows with errors aside, under their batch, and give back the clean ones."""
    bad = F.size(errors) > 0
    write_batch(df.where(bad), path, batch)
    return df.where(~bad).drop(errors)


def append_report(df: DataFrame, path: str, batch: str) -> None:
    write_batch(df, path, batch)


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def unload(df: DataFrame, path: str) -> None:
    """Query result to Parquet."""
    df.write.mode("overwrite").parquet(path)
