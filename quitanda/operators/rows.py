"""Row filters and projections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from quitanda.functions.dates import default_range


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def drop_empty(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows whose business columns are all null."""
    return df.na.drop("all", subset=cols or business_columns(df))


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def part_of(parts: int, *keys: str) -> Column:
    """Which of ``parts`` parts of its table a row belongs to; rows of equal ``keys`` share a part."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)


def in_range(df: DataFrame, col: str, start: date, end: date) -> DataFrame:
    """Whole days ``start``..``end``, compared on the raw column so the filter is pushed down."""
    kind = dict(df.dtypes)[col]
    last = F.date_add(F.lit(end), 1)
    return df.where((F.col(col) >= F.lit(start).cast(kind)) & (F.col(col) < last.cast(kind)))


def in_default_range(df: DataFrame, col: str, as_of: date, start: date | None = None,
                     end: date | None = None) -> DataFrame:
    return in_range(df, col, *default_range(as_of, start, end))


def exclude_status(df: DataFrame, value: str = "CANCELADA", col: str = "status_venda") -> DataFrame:
    """SQL semantics: a null status is not ``<>`` anything and drops too."""
    return df.where(F.col(col) != value)


def current_rows(dim: DataFrame) -> DataFrame:
    return dim.where("registro_atual")


def select_existing(df: DataFrame, cols) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def meta_last(df: DataFrame) -> DataFrame:
    meta = [c for c in df.columns if c.startswith("_")]
    return df.select(*business_columns(df), *meta)


def with_audit(df: DataFrame, job: str, as_of: Column, batch_id: str | None = None) -> DataFrame:
    cols = {"_processed_at": as_of, "_job_name": F.lit(job)}
    if batch_id is not None:
        cols |= {"stg_load_timestamp": as_of, "stg_batch_id": F.lit(batch_id)}
    return df.withColumns(cols)


def first_existing(df: DataFrame, *cols: str) -> Column:
    """The first of ``cols`` that the frame has (chosen while planning)."""
    return next(F.col(c) for c in cols if c in df.columns)


def with_defaults(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v).cast(dict(df.dtypes)[c])) for c, v in values.items()
    })


def changed(left: str, right: str, tracked) -> Column:
    """Any tracked column differs, null-safe."""
    test = F.lit(False)
    for c in tracked:
        test = test | ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return test


def in_month(df: DataFrame, as_of: date, year: str = "ano", month: str = "mes") -> DataFrame:
    return df.where((F.col(year) == as_of.year) & (F.col(month) == as_of.month))


def has_any(df: DataFrame, predicate: Column) -> bool:
    """Existence probe; stops at the first match."""
    return not df.where(predicate).isEmpty()


def any_row(predicate: Column) -> Column:
    """The same probe as one aggregate of the plan: false for an empty table, nulls are no match."""
    return F.coalesce(F.bool_or(predicate), F.lit(False))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenate by column name; a column missing from a frame is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Sort and keep n: TakeOrderedAndProject, n rows per task."""
    return df.orderBy(*order).limit(n)


def latest_first(col: str) -> Column:
    return F.col(col).desc_nulls_last()
