"""Incremental loads: cursors, full refresh, date-range reloads."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from quitanda.operators.rows import in_range


def newer_than(source: DataFrame, cursor: str, last) -> DataFrame:
    """Rows past the saved cursor; everything on the first run."""
    return source if last is None else source.where(F.col(cursor) > F.lit(last))


def saved_cursor(spark: SparkSession, target: str, cursor: str, before: str | None = None):
    """Greatest cursor value of the batches kept in ``target``, those before batch ``before`` if given."""
    try:
        kept = spark.read.parquet(target)
    except AnalysisException:
        return None  # nothing was loaded yet
    return (kept if before is None else kept.where(F.col("lote") < before)).agg(F.max(cursor)).first()[0]


def incremental_append(spark: SparkSession, source: DataFrame, target: str, cursor: str, batch: str):
    """Append rows past the saved cursor as batch ``batch`` and give back the new cursor.

    The cursor is what the target itself holds from earlier batches, so it cannot disagree with the
    data: a retry of the batch reads the same rows again and replaces its own folder. Batches sort
    by name; nothing new writes nothing.
    """
    last = saved_cursor(spark, target, cursor, batch)
    rows = newer_than(source, cursor, last)
    if rows.isEmpty():
        return last
    seen = Observation()
    rows.observe(seen, F.max(cursor).alias("top")).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(f"{target}/lote={batch}")
    return seen.get["top"]


def full_refresh(source: DataFrame, target: str) -> None:
    source.write.mode("overwrite").parquet(target)


def outside_range(table: DataFrame, day: str, start: date, end: date) -> DataFrame:
    kind = dict(table.dtypes)[day]
    c = F.col(day)
    before = c < F.lit(start).cast(kind)
    after = c >= F.date_add(F.lit(end), 1).cast(kind)
    return table.where(before | after | c.isNull())


def range_reload(table: DataFrame, new: DataFrame, day: str, start: date, end: date) -> DataFrame:
    """Delete the closed date range and insert the new rows of that range."""
    return outside_range(table, day, start, end).unionByName(
        in_range(new, day, start, end), allowMissingColumns=True)
