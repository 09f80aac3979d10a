"""Identity, contact and place text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The data contract names exactly these.
STATES = (
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA",
    "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
)
REGIONS = {
    "NORTE": ("AC", "AM", "AP", "PA", "RO", "RR", "TO"),
    "NORDESTE": ("AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"),
    "CENTRO-OESTE": ("DF", "GO", "MS", "MT"),
    "SUDESTE": ("ES", "MG", "RJ", "SP"),
    "SUL": ("PR", "RS", "SC"),
}
UNKNOWN_REGION = "DESCONHECIDO"
NAME_PARTICLES = ("da", "de", "do", "das", "dos", "e", "em")
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def clean_cpf(c: Column) -> Column:
    """Eleven digits that are not all the same; anything else is null."""
    d = digits(c)
    repeated = d == F.repeat(F.substring(d, 1, 1), 11)
    return F.when((F.length(d) == 11) & ~repeated, d)


def valid_email(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(EMAIL_PATTERN), F.lit(False))


def clean_email(c: Column) -> Column:
    return F.when(valid_email(c), c)


def clean_name(c: Column) -> Column:
    """One space between words, each capitalised except particles after the first word."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), " ")
    cased = F.transform(
        words,
        lambda w, i: F.when((i > 0) & w.isin(*NAME_PARTICLES), w).otherwise(F.initcap(w)),
    )
    return F.nullif(F.array_join(cased, " "), F.lit(""))


def clean_phone(c: Column) -> Column:
    d = digits(c)
    return F.when(
        F.length(d).isin(10, 11),
        F.regexp_replace(d, r"^(\d{2})(\d{4,5})(\d{4})$", r"($1) $2-$3"),
    )


def clean_state(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return F.when(s.isin(*STATES), s)


def region_of(state: Column) -> Column:
    out = None
    for region, members in REGIONS.items():
        test = state.isin(*members)
        out = F.when(test, region) if out is None else out.when(test, region)
    return out.otherwise(UNKNOWN_REGION)


def length_between(c: Column, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def in_set(c: Column, values) -> Column:
    return F.upper(c).isin(*values)


def null_if_invalid(c: Column, valid: Column) -> Column:
    return F.when(valid, c)
