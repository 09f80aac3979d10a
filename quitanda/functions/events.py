"""Event fields, JSON and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def product_of(properties_id: Column, product_id: Column) -> Column:
    """Product seen by an event: the click property, else the purchased product."""
    return F.coalesce(F.nullif(properties_id, F.lit("")), F.nullif(product_id, F.lit("")))


def purchase_value(event_type: Column, value: Column) -> Column:
    """Revenue carried by an event; a purchase without value counts as zero."""
    return F.when(event_type == "PURCHASE_COMPLETED", F.coalesce(value, F.lit(0))).otherwise(0)


def decode_json(c: Column, schema) -> Column:
    return F.from_json(c, schema)


def encode_json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def etag(c: Column) -> Column:
    return F.md5(c)


def token(c: Column) -> Column:
    return F.sha2(c, 256)
