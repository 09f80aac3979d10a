"""Edge cases of the column functions."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quitanda.functions import dates, events, money, privacy, text


def outputs(spark, fn, inputs, ddl="s string"):
    df = spark.createDataFrame([(i,) for i in inputs], ddl)
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


CASES = [
    (text.clean_cpf, [("123.456.789-01", "12345678901"), ("00000000001", "00000000001"), ("111.111.111-11", None),
                      ("1234567890", None), ("123456789012", None), ("", None), (None, None)]),
    (text.valid_email, [("a.b@x.com", True), (" c@x.org ", True), ("a@x", False), ("a@b@c.com", False), (None, False)]),
    (text.clean_name, [("JOÃO DA SILVA", "João da Silva"), ("maria santos  ", "Maria Santos"), ("DA SILVA", "Da Silva"),
                       ("ana   e  bia", "Ana e Bia"), ("  ", None), (None, None)]),
    (text.clean_phone, [("11987654321", "(11) 98765-4321"), ("(11) 3333-4444", "(11) 3333-4444"), ("123456789", None),
                        (None, None)]),
    (text.clean_state, [(" sp ", "SP"), ("XX", None), (None, None)]),
    (text.region_of, [("SP", "SUDESTE"), ("TO", "NORTE"), ("DF", "CENTRO-OESTE"), ("ZZ", "DESCONHECIDO"), (None, "DESCONHECIDO")]),
    (money.parse_money, [("R$ 1.250,99", Decimal("1250.99")), ("1.250,99", Decimal("1250.99")), ("1250.99", Decimal("1250.99")),
                         ("10,5", Decimal("10.50")), ("1.250", Decimal("1.25")), ("R$ -5", None), ("-", None), ("", None),
                         ("abc", None), ("1d", None), ("NaN", None), ("1.2.3", None), (None, None)]),
    (money.to_integer, [("12", 12), ("n/d", None), ("", None)]),
    (dates.parse_date, [("2024-02-29", date(2024, 2, 29)), ("2024-02-30", None), ("29/02/2024", None), (None, None)]),
    (privacy.mask_cpf, [("12345678901", "***.456.789-**"), ("123.456.789-01", "***.456.789-**")]),
    (privacy.mask_phone, [("(11) 98765-4321", "(11) 9****-****"), ("(11) 3333-4444", "(11) 3****-****")]),
    (privacy.anonymize_ip, [("192.168.1.123", "192.168.1.xxx")]),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=[c[0].__name__ for c in CASES])
def test_text_functions(spark, fn, cases):
    assert outputs(spark, fn, [c[0] for c in cases]) == [c[1] for c in cases]


def test_value_band(spark):
    cases = [("0", "PEQUENA"), ("99.99", "PEQUENA"), ("100", "MEDIA"), ("500", "GRANDE"), ("2000", "PREMIUM"),
             ("-1", "DESCONHECIDO"), (None, "DESCONHECIDO")]
    got = outputs(spark, lambda c: money.value_band(c.cast("decimal(15,2)")), [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_margin(spark):
    df = spark.createDataFrame([("100", "40"), ("0", "10"), ("100", None), ("3", "2"), ("100", "150")], "v string, c string")
    d = lambda c: F.col(c).cast("decimal(15,2)")
    got = [r[0] for r in df.select(money.margin_pct(d("v"), d("c"))).collect()]
    assert got == [Decimal("60.0000"), None, None, Decimal("33.3300"), Decimal("-50.0000")]


def test_mean_rounds_half_up_exactly(spark):
    df = spark.createDataFrame([("0.01", 2), ("-0.01", 2), ("2.01", 2), ("1.00", 0)], "s string, n int")
    got = [r[0] for r in df.select(money.mean_of(F.col("s").cast("decimal(18,2)"), F.col("n"))).collect()]
    assert got == [Decimal("0.01"), Decimal("-0.01"), Decimal("1.01"), None]


def test_calendar_attributes(spark):
    from quitanda.plans.calendar import calendar, days_between

    days = {r.data_completa: r for r in calendar(days_between(spark, date(2022, 1, 1), date(2026, 12, 31))).collect()}
    assert len(days) == 1826
    sunday = days[date(2024, 1, 7)]
    assert (sunday.dia_semana_num, sunday.semana_do_ano, sunday.dia_semana_nome, sunday.fim_de_semana) == (1, 1, "Domingo", True)
    assert days[date(2023, 1, 1)].semana_do_ano == 52
    assert days[date(2024, 2, 29)].ultimo_dia_mes and not days[date(2024, 2, 28)].ultimo_dia_mes
    assert days[date(2024, 3, 1)].mes_nome == "Março" and days[date(2024, 3, 1)].sk_tempo == 20240301


def test_fiscal_and_age(spark):
    df = spark.createDataFrame([(date(2024, 3, 31),), (date(2024, 4, 1),)], "d date")
    got = df.select(dates.fiscal_year(F.col("d"), 4), dates.fiscal_month(F.col("d"), 4)).collect()
    assert [tuple(r) for r in got] == [(2023, 12), (2024, 1)]
    born = spark.createDataFrame([(date(2006, 6, 30),), (date(2006, 7, 1),), (None,)], "d date")
    band = dates.age_band(F.col("d"), F.lit(date(2024, 6, 30)))
    assert [r[0] for r in born.select(band).collect()] == ["18-24", "<18", None]


def test_event_product_and_revenue(spark):
    df = spark.createDataFrame([("P1", "P2"), ("", "P2"), (None, "P2"), (None, None), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(events.product_of(F.col("a"), F.col("b"))).collect()] == ["P1", "P2", "P2", None, None]
    ev = spark.createDataFrame([("PURCHASE_COMPLETED", 5.0), ("PURCHASE_COMPLETED", None), ("PAGE_VIEW", 9.0)], "t string, v double")
    assert [float(r[0]) for r in ev.select(events.purchase_value(F.col("t"), F.col("v"))).collect()] == [5.0, 0.0, 0.0]


def test_default_range_and_batch_id():
    from datetime import datetime

    assert dates.default_range(date(2024, 1, 2)) == (date(2024, 1, 1), date(2024, 1, 2))
    assert dates.batch_id(datetime(2024, 1, 2, 3, 4, 5)) == "BATCH_20240102_030405"
    assert dates.batch_id(None, "B7") == "B7"
