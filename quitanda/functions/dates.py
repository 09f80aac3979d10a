"""Dates, calendar attributes and labels."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F

# Portuguese calendar names, January and Sunday first.
MONTHS = ("Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto",
          "Setembro", "Outubro", "Novembro", "Dezembro")
MONTHS_SHORT = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")
WEEKDAYS = ("Domingo", "Segunda-Feira", "Terça-Feira", "Quarta-Feira", "Quinta-Feira",
            "Sexta-Feira", "Sábado")
WEEKDAYS_SHORT = ("Dom", "Seg", "Ter", "Qua", "Qui", "Sex", "Sab")
WEEKDAYS_ENGLISH = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# Age bands: our own choice, lower bound (inclusive) of each.
AGE_BANDS = (("<18", 0), ("18-24", 18), ("25-34", 25), ("35-44", 35), ("45-59", 45), ("60+", 60))


def parse_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def parse_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def date_key(d: Column) -> Column:
    """YYYYMMDD as an integer."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HH")


def two_digits(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def weekday_english(d: Column) -> Column:
    return name_at(WEEKDAYS_ENGLISH, F.dayofweek(d))


def name_at(names, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position.cast("int"))


def semester(d: Column) -> Column:
    return F.when(F.month(d) <= 6, 1).otherwise(2)


def is_weekend(d: Column) -> Column:
    return F.dayofweek(d).isin(1, 7)


def is_month_end(d: Column) -> Column:
    return F.last_day(d) == d


def days_since(as_of: Column, d: Column) -> Column:
    return F.datediff(as_of, d)


def age_years(birth: Column, as_of: Column) -> Column:
    """Completed years; the birthday itself counts."""
    had_birthday = F.month(as_of) * 100 + F.dayofmonth(as_of) >= F.month(birth) * 100 + F.dayofmonth(birth)
    return F.year(as_of) - F.year(birth) - F.when(had_birthday, 0).otherwise(1)


def age_band(birth: Column, as_of: Column) -> Column:
    age = age_years(birth, as_of)
    out = F.when(age.isNull(), F.lit(None).cast("string"))
    for name, low in reversed(AGE_BANDS[1:]):
        out = out.when(age >= low, name)
    return out.otherwise(AGE_BANDS[0][0])


def fiscal_year(d: Column, start_month: int) -> Column:
    """The fiscal year is named after the calendar year in which it starts."""
    return F.year(F.add_months(d, 1 - start_month))


def fiscal_month(d: Column, start_month: int) -> Column:
    return F.month(F.add_months(d, 1 - start_month))


def default_range(as_of: date, start: date | None = None, end: date | None = None) -> tuple[date, date]:
    """Yesterday to today unless given."""
    return start or as_of - timedelta(days=1), end or as_of


def batch_id(clock, given: str | None = None) -> str:
    return given or f"BATCH_{clock:%Y%m%d_%H%M%S}"
