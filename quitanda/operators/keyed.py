"""One row per key, change feeds and key differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the greatest ``order`` per key, nulls last; ties broken by the whole row.

    An aggregate rather than a window: partial maxima are taken before the shuffle, so a key
    holding most of the rows costs one row per input task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("best")
    return df.groupBy(*keys).agg(best).select(*[
        F.col(c) if c in keys else F.col(f"best.{c}").alias(c) for c in df.columns
    ])


def minus_by_key(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is absent from ``b``."""
    return a.join(b.select(*keys), keys, "left_anti")


def apply_changes(table: DataFrame, feed: DataFrame, keys: list[str], sequence: str,
                  op: str = "op") -> DataFrame:
    """Apply insert (I), update (U) and delete (D) records; the last one per key wins."""
    last = latest_per_key(feed, keys, [sequence])
    untouched = minus_by_key(table, last, keys)
    return untouched.unionByName(last.where(F.col(op) != "D").select(*table.columns))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
