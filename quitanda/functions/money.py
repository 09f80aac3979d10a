"""Money text, rounding and ratios. Money is decimal from the first operation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(15,2)"
TOTAL = "decimal(18,2)"
# Wide enough for a percentage of a one-cent base.
PERCENT = "decimal(18,4)"

# Lower bound (inclusive) of each value band.
VALUE_BANDS = (("PEQUENA", 0), ("MEDIA", 100), ("GRANDE", 500), ("PREMIUM", 2000))
UNKNOWN_BAND = "DESCONHECIDO"


def parse_money(c: Column) -> Column:
    """Brazilian or plain number text to decimal; negative or unreadable text is null.

    With both separators the dot groups thousands; a lone comma is the decimal mark; a
    lone dot is a decimal point (``1.250`` is 1.25).
    """
    t = F.trim(F.replace(c, F.lit("R$"), F.lit("")))
    plain = F.when(t.contains(","), F.translate(t, ",.", ".")).otherwise(t)  # drops dots, comma to dot
    return F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain).try_cast(MONEY)


def value_band(value: Column) -> Column:
    out = F.when(value.isNull() | (value < 0), UNKNOWN_BAND)
    for name, low in reversed(VALUE_BANDS):
        out = out.when(value >= low, name)
    return out


def ratio(num: Column, den: Column) -> Column:
    """Division that gives null for a zero divisor."""
    return F.try_divide(num, den)


def round2(c: Column) -> Column:
    return F.round(c, 2)


def margin_pct(value: Column, cost: Column) -> Column:
    """(value - cost) / value in percent, two decimals half up; null without value or cost."""
    return round2(ratio((value - cost) * 100, value)).cast(PERCENT)


def margin_value(value: Column, cost: Column) -> Column:
    return F.when(cost.isNotNull(), value - cost).cast(MONEY)


def mean_of(total: Column, count: Column, out: str = MONEY, scale: int = 2) -> Column:
    """Exact decimal mean of an already summed amount, rounded half up."""
    # 18 digits before the point and a count of 12 digits more keep four decimals of the quotient
    whole, n = total.cast("decimal(26,4)"), count.cast("decimal(20,0)")
    return F.round(ratio(whole, n), scale).cast(out)


def percent_of(part: Column, whole: Column, scale: int = 2) -> Column:
    """part / whole in percent, null for a zero whole, exact decimal rounding."""
    return F.round(
        ratio(part.cast("decimal(22,2)") * F.lit(100), whole.cast("decimal(22,2)")), scale
    ).cast(PERCENT)


def growth_pct(now: Column, before: Column) -> Column:
    """(now / before - 1) in percent, two decimals; null without a non-zero ``before``."""
    return percent_of(now - before, before)


def to_integer(c: Column) -> Column:
    """Number text to bigint; unreadable text is null."""
    return c.try_cast("bigint")
