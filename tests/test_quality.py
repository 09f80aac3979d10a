"""Suites, validation, alerts, retention, discovery."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quitanda.functions import privacy
from quitanda.operators import alerts, discovery, quality as dq, retention, rows as ops, validation as val, windows
from quitanda.operators.keyed import apply_changes, latest_per_key


def test_missing_columns(spark, rows):
    df = rows([("12345678901",)] * 12, "cpf string")
    got = {r.check: r for r in dq.run_suite(df, dq.customer_suite()).collect()}
    assert not got["Nome não-nulo"].passou and got["Nome não-nulo"].valor_atual == 0
    assert "Email formato válido" not in got and got["CPF tamanho válido"].passou
    assert not got["CPF unicidade"].passou and got["Volume mínimo (>=10)"].status == "PASSOU"
    with pytest.raises(ValueError):
        dq.run_suite(rows([(1,)], "x int"), [dq.expect_positive("y", 1.0)])


def test_suite_on_an_empty_table(spark, rows):
    got = {r.check: r.passou for r in dq.run_suite(rows([], "valor_total decimal(15,2)"), dq.sales_suite()).collect()}
    assert got["Volume mínimo (>=1)"] is False


def test_unknown_expectation():
    with pytest.raises(KeyError):
        dq.load_suite('{"expectations": [{"expectation_type": "x", "kwargs": {}}]}')


def test_assertions(spark, rows):
    df = rows([(1,), (-1,)], "v int")
    assert dq.assert_none(df, F.col("v") < 0, "negativo", "warning")
    with pytest.raises(ValueError, match="negativo"):
        dq.assert_none(df, F.col("v") < 0, "negativo")


def test_column_report(rows):
    df = rows([(1, 1, 1)], "ID_VENDA int, Valor_Total int, extra int")
    got = val.column_report(df, val.SPECS["vendas"])
    assert got["obrigatorias_ausentes"] == ["cpf_cliente", "data_venda"] and got["extras"] == ["extra"]


def test_file_verdicts(rows):
    spec = val.SPECS["vendas"]
    good = ("1", "c", "10.00", "2024-01-01")
    df = rows([(*good, "a"), (*good, "b"), ("2", "c", None, "d", "b"), ("3", "c", "R$ 0,00", "d", "c")],
              "id_venda string, cpf_cliente string, valor_total string, data_venda string, _source_file string")
    files = rows([("a",), ("b",), ("c",), ("vazio",)], "_source_file string")
    got = {r._source_file: r.valido for r in val.validate_files(df, spec, files=files).collect()}
    assert got == {"a": True, "b": False, "c": False, "vazio": False}
    t = val.verdict_totals(val.validate_files(df, spec, files=files)).first()
    assert (t.total_arquivos, t.validos, t.codigo) == (4, 1, 400)
    lacking = val.validate_files(df.drop("cpf_cliente"), spec).where("valido").count()
    assert lacking == 0


def test_dataset_of_path(rows):
    df = rows([("raw/clientes/a.json",), ("s3a://b/raw/vendas/ano=1/x.csv",), ("raw/meusclientes/a",)], "p string")
    assert [r[0] for r in df.select(val.dataset_of(F.col("p"))).collect()] == ["clientes", "vendas", None]


def test_alerts(spark, rows):
    now = F.lit("2024-01-02 02:00:00").cast("timestamp")
    df = rows([(datetime(2024, 1, 1, 0, 0),)], "ts timestamp")
    assert alerts.freshness_alert(df, "ts", now).first().alerta
    assert not alerts.freshness_alert(df, "ts", now, 27).first().alerta
    assert alerts.freshness_alert(df.where("false"), "ts", now).first().alerta
    daily = rows([(1, 100), (2, 79), (3, 78)], "dia int, linhas int")
    assert [r.dia for r in alerts.row_drop_alert(daily).collect()] == [2]
    assert windows.row_drops(daily).where("dia = 1").first().alerta is False


def test_retention(rows):
    objs = rows([("raw/a", 90), ("raw/b", 89), ("raw/c", 820), ("processed/d", 180), ("other/e", 999), ("raw/f", 83)], "key string, age int").select(
        "key", F.lit(10).alias("bytes"), F.expr("timestamp'2024-06-01' - make_dt_interval(age)").alias("modified"))
    plan = retention.retention_plan(objs, F.lit("2024-06-01"))
    got = {r.key: (r.acao, r.nova_chave) for r in plan.collect()}
    assert got == {"raw/a": ("arquivar", "archived/a"), "raw/b": ("manter", None), "raw/c": ("deletar", None),
                   "processed/d": ("arquivar", "archived/d"), "raw/f": ("manter", None)}
    assert {r.key for r in retention.due_soon(plan).collect()} == {"raw/b", "raw/f"}


def test_discovery(rows):
    objs = rows([("raw/vendas-loja/ano=2024/mes=01/a.csv", 1), ("raw/vendas-loja/ano=2024/mes=02/b.csv", 2), ("raw/x/c.json", 3)], "key string, bytes int")
    got = {r.tabela: r for r in discovery.crawl(objs).collect()}
    assert got["raw_vendas_loja"].localizacao == "raw/vendas-loja/" and got["raw_vendas_loja"].particoes == "ano,mes"
    assert got["raw_x"].localizacao == "raw/x/" and got["raw_x"].formato == "json"
    text = rows([("1", "R$ 1.250,99", "2024-01-01", "x", None), ("22", "10,5", "2024-01-02 10:00:00", "1", "")], "a string, b string, c string, d string, e string")
    assert {r.coluna: r.tipo for r in discovery.infer_types(text).collect()} == {
        "a": "bigint", "b": "double", "c": "timestamp", "d": "string", "e": "string"}
    cols = rows([("t", "v", "bigint"), ("t", "v", "double"), ("t", "v", "string"), ("t", "w", "bigint"), ("t", "w", "double")], "tabela string, coluna string, tipo string")
    assert {r.coluna: r.tipo for r in discovery.merge_schemas(cols).collect()} == {"v": "string", "w": "double"}


def test_drop_sensitive(rows):
    df = rows([(1, "t")], "id int, token string").withColumn("conta", F.struct(F.lit(1).alias("senha"), F.lit(2).alias("ok")))
    assert privacy.drop_sensitive(df).schema.simpleString() == "struct<id:int,conta:struct<ok:int>>"


def test_latest_per_key_nulls_last_and_ties(rows):
    df = rows([("a", None, 9), ("a", 1, 1), ("a", 1, 2), ("b", None, 1), ("b", None, 3)], "k string, d int, v int")
    assert sorted(tuple(r) for r in latest_per_key(df, ["k"], ["d"]).collect()) == [("a", 1, 2), ("b", None, 3)]


def test_change_feed(rows):
    table = rows([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    feed = rows([(1, "x", "U", 1), (1, "y", "U", 2), (2, "b", "D", 1), (4, "n", "I", 1), (4, "n", "D", 2)], "id int, v string, op string, seq int")
    assert sorted(tuple(r) for r in apply_changes(table, feed, ["id"], "seq").collect()) == [(1, "y"), (3, "c")]


def test_null_status_is_excluded(rows):
    assert ops.exclude_status(rows([("CANCELADA",), (None,), ("CONCLUIDA",)], "status_venda string")).count() == 1
