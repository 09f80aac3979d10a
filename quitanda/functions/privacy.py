"""Masking and hashing of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from quitanda.functions.text import digits

# Fields an event must never carry into the lake.
SENSITIVE_FIELDS = ("credit_card", "senha", "token")


def hash_cpf(cpf: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), digits(cpf)), 256)


def mask_cpf(cpf: Column) -> Column:
    """Keep the middle block: ``***.456.789-**``."""
    return F.regexp_replace(digits(cpf), r"^\d{3}(\d{3})(\d{3})\d{2}$", r"***.$1.$2-**")


def mask_phone(phone: Column) -> Column:
    """Keep area code and first digit: ``(11) 9****-****``."""
    return F.regexp_replace(phone, r"^(\(\d{2}\) \d)\d{3,4}-\d{4}$", r"$1****-****")


def anonymize_ip(ip: Column) -> Column:
    return F.regexp_replace(ip, r"\.\d+$", ".xxx")


def drop_sensitive(df: DataFrame, fields=SENSITIVE_FIELDS) -> DataFrame:
    """Drop the fields at the top level and inside every struct column."""
    kept = df.drop(*fields)
    for f in kept.schema.fields:
        if isinstance(f.dataType, StructType):
            inner = [n for n in fields if n in f.dataType.names]
            if inner:
                kept = kept.withColumn(f.name, F.col(f.name).dropFields(*inner))
    return kept


def anonymize_old(df: DataFrame, day: str, as_of: Column, years: int = 5,
                  cpf: str = "cpf", name: str = "nome") -> DataFrame:
    """Mask CPF and name in rows older than ``years``."""
    old = F.col(day) < F.add_months(as_of, -12 * years)
    return df.withColumns({
        cpf: F.when(old, mask_cpf(F.col(cpf))).otherwise(F.col(cpf)),
        name: F.when(old, F.lit("ANONIMIZADO")).otherwise(F.col(name)),
    })
