"""Queries over the given tables, each with SQL a second engine can run.

A query shows one operator of the library at work on whole tables. The SQL is written
independently of the Spark code.
"""

from catalog.registry import ORACLES, QUERIES
from catalog import (  # noqa: F401  (importing registers)
    chain, files, joining, quality, rows, scalars, streams, totals, upkeep, warehouse, windowing,
)

__all__ = ["ORACLES", "QUERIES"]
