"""Raw files through the jobs."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quitanda.plans import customers, daily, sales
from quitanda.session import conf
from quitanda.sources import files, sinks
from quitanda.sources.arrivals import csv_arrivals, read_sales, validate_arrivals


@pytest.fixture()
def raw(tmp_path):
    folder = tmp_path / "raw" / "clientes" / "ano=2024"
    folder.mkdir(parents=True)
    person = lambda n, **kw: {"cpf": f"{n:011d}", "nome": f"PESSOA {n}", "uf": "sp", "data_cadastro": "2024-01-01", **kw}
    docs = {
        "envelope.json": {"clientes": [person(1), person(2, uf="XX")], "total": 2, "gerado_em": "x"},
        "data.json": {"data": [person(3, email="ruim")]},
        "list.json": [person(4), person(1, nome="NOVO NOME", data_cadastro="2024-02-01")],
        "one.json": person(5, uf=None, estado="rj"),
        "badcpf.json": [person(6, cpf="111.111.111-11"), person(7, data_cadastro="ontem"), person(7)],
    }
    for name, doc in docs.items():
        (folder / name).write_text(json.dumps(doc, indent=2))
    (folder / "broken.json").write_text('{"clientes": [')
    return str(tmp_path / "raw" / "clientes")


NOW = "2024-03-01"


def test_customer_job(spark, raw, tmp_path):
    out = str(tmp_path / "clientes")
    got = customers.run(spark, raw, out, F.lit(NOW).cast("timestamp"))
    assert got["status"] == "SUCCESS" and got["gravados"] == 6
    people = {r.cpf[-1]: r for r in spark.read.parquet(out).collect()}
    assert sorted(people) == ["1", "2", "3", "4", "5", "7"]
    assert people["1"].nome == "Novo Nome"
    assert people["2"].uf is None and people["5"].uf == "RJ" and people["3"].email is None
    assert people["7"].data_cadastro is not None
    assert (tmp_path / "clientes" / "uf=SP").exists() and (tmp_path / "clientes" / "uf=__HIVE_DEFAULT_PARTITION__").exists()


def test_customer_job_repeats(spark, raw, tmp_path):
    out = str(tmp_path / "clientes")
    for _ in range(2):
        customers.run(spark, raw, out, F.lit(NOW).cast("timestamp"))
    assert spark.read.parquet(out).count() == 6


def test_malformed_document_is_visible(spark, raw):
    docs = files.customer_documents(spark, raw).cache()
    assert docs.where("_corrupt_record is not null").count() == 1


def test_columns_end_with_metadata(spark, raw):
    rows = files.customers_json(spark, raw, F.lit(NOW).cast("timestamp"))
    cols = customers.transform_customers(rows, F.lit(NOW).cast("timestamp")).columns
    assert [c.startswith("_") for c in cols] == sorted(c.startswith("_") for c in cols)


@pytest.fixture()
def lake(spark, raw, tmp_path):
    folder = tmp_path / "raw" / "vendas"
    folder.mkdir(parents=True)
    head = "id_venda,cpf_cliente,data_venda,valor_total,custo,canal_venda,quantidade"
    body = ["1,000.000.000-01,2024-01-05 10:00:00,\"R$ 1.250,99\",1000.00,ECOMMERCE,2",
            "2,00000000003,2024-01-05,99.99,40,LOJA_FISICA,1", "3,00000000099,2024-02-01,\"10,5\",,PIX,1",
            "4,00000000001,sem data,500.00,100,ECOMMERCE,1", "5,00000000001,2024-02-01,abc,1,ECOMMERCE,1",
            "6,00000000001,2024-02-01,R$ -5,1,ECOMMERCE,1", ",,,,,,"]
    (folder / "v.csv").write_text("\n".join([head, *body]) + "\n")
    people = str(tmp_path / "clientes")
    customers.run(spark, raw, people, F.lit(NOW).cast("timestamp"))
    return str(folder), people, str(tmp_path / "vendas"), head.split(",")


def _run(spark, lake):
    folder, people, out, cols = lake
    source, aside = read_sales(spark, folder, cols, F.lit(NOW).cast("timestamp"))
    assert aside.count() == 0
    result = sales.transform_sales(source, files.processed_customers(spark, people), F.lit(NOW).cast("timestamp"))
    sinks.write_sales(result, out)
    return spark.read.parquet(out)


def test_sales_job(spark, lake):
    rows = {r.id_venda: r for r in _run(spark, lake).collect()}
    assert sorted(rows) == ["1", "2", "3", "4"]
    one = rows["1"]
    assert (str(one.valor_total), one.categoria_valor, str(one.margem_pct), one.nome, one.ano, one.mes, one.dia_semana) == (
        "1250.99", "GRANDE", "20.0600", "Novo Nome", "2024", "01", "Friday")
    assert rows["3"].nome is None and rows["3"].margem_pct is None
    assert rows["4"].ano is None and rows["4"].data_venda is None


def test_sales_job_repeats(spark, lake):
    assert _run(spark, lake).count() == _run(spark, lake).count() == 4


def test_daily_job(spark, lake, tmp_path):
    _run(spark, lake)
    out = str(tmp_path / "agg")
    got = daily.run(spark, lake[2], out, date(2024, 1, 5))
    assert got["agregacoes"] == ["top_clientes", "vendas_por_categoria", "vendas_por_dia_uf"]
    assert spark.read.json(f"{out}/vendas_por_dia_uf").count() == 1
    daily.run(spark, lake[2], out, date(2024, 1, 5))
    assert spark.read.json(f"{out}/vendas_por_dia_uf").count() == 1
    assert daily.run(spark, lake[2], out, date(2031, 1, 1))["status"] == "SUCCESS_NO_DATA"


def test_month_scan_reads_one_partition(spark, lake):
    _run(spark, lake)
    plan = files.processed_sales(spark, lake[2], date(2024, 1, 5))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan
    assert files.processed_sales(spark, lake[2], date(2024, 1, 5)).count() == 2
    assert files.processed_sales(spark, lake[2], date(2024, 1, 4), only_day=True).count() == 0


def test_empty_input(spark, tmp_path):
    folder = tmp_path / "vazio"
    folder.mkdir()
    (folder / "a.json").write_text("[]")
    got = customers.run(spark, str(folder), str(tmp_path / "out"), F.lit(NOW).cast("timestamp"))
    assert got["status"] == "SUCCESS_NO_DATA"


def test_jdbc_and_kafka_options():
    from quitanda.sources import external

    opts = external.jdbc_incremental("jdbc:x", "clientes", "data_cadastro", "2024-01-01", key="id", bounds=(1, 100), partitions=4)
    assert opts["dbtable"] == "(SELECT * FROM clientes WHERE data_cadastro > '2024-01-01') AS novos"
    assert external.jdbc_full("jdbc:x", "contatos_clientes")["dbtable"] == "contatos_clientes"
    assert external.kafka_read("h:9092", "eventos-website", 100)["startingOffsets"] == "earliest"


def test_snapshot_report_and_unload(spark, rows, tmp_path):
    df = rows([(1, "a"), (2, "b")], "n int, s string")
    for _ in range(2):
        sinks.append_report(df, str(tmp_path / "r"), "B1")
        sinks.write_snapshot(df, str(tmp_path / "s"))
        sinks.unload(df, str(tmp_path / "u"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_first_list_of_a_document(spark, raw):
    got = files.first_list_json(spark, raw, "cpf:string,nome:string").collect()
    assert sorted(r.cpf[-1] for r in got) == ["1", "1", "1", "2", "3", "4", "7", "7"]


def test_arrived_files_keep_their_path(spark, tmp_path):
    from quitanda.operators import discovery, validation as val

    folder = tmp_path / "raw" / "vendas"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("id_venda,valor_total\n1,10.5\n2,\n")
    (folder / "b.csv").write_text("id_venda,valor_total\n")
    found = validate_arrivals(csv_arrivals(spark, str(folder)), val.SPECS["vendas"])
    got = {r._source_file.rsplit("/", 1)[1]: (r.total_registros, r.erros, r.valido, r.colunas_ausentes) for r in found.collect()}
    assert got == {"a.csv": (2, 1, False, "cpf_cliente,data_venda"), "b.csv": (0, 0, False, "cpf_cliente,data_venda")}
    assert dict(discovery.columns_of(spark, str(folder), "csv", header=True, inferSchema=True))["valor_total"] == "double"
    (tmp_path / "j.json").write_text('[{"a": 1, "b": "x"}]')
    assert discovery.columns_of(spark, str(tmp_path / "j.json"), "json", multiLine=True) == [("a", "bigint"), ("b", "string")]


def test_months_past_the_limit_go_as_folders(spark, rows, tmp_path):
    days = [date(2023, 12, 31), date(2024, 1, 5), date(2024, 2, 9), date(2024, 2, 10), date(2024, 3, 1), None]
    out = str(tmp_path / "meses")
    sinks.write_partitioned(sinks.with_year_month(rows([(i, d) for i, d in enumerate(days)], "n int, d date"), "d"), out, ["ano", "mes"])
    written = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "meses").rglob("*.parquet")}
    before = written()
    assert sinks.expire_months(spark, out, "d", date(2024, 2, 10)) == ["ano=2023/mes=12", "ano=2024/mes=01"]
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [3, 4, 5]
    after = written()
    assert sum(f in before and before[f] == t for f, t in after.items()) == 2  # March and the undated row
    assert sinks.expire_months(spark, out, "d", date(2024, 2, 10)) == [] and written() == after


def test_a_large_write_makes_few_files_a_folder(spark, tmp_path):
    with conf(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="256KB"):
        day = F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 200).cast("int"))
        big = spark.range(100_000, numPartitions=16).select(day.alias("d"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        got = sinks.replace_days(big, str(tmp_path / "t"), "d", date(2024, 1, 1), date(2024, 7, 18))
    assert got.count() == 100_000 and got.select("dia").distinct().count() == 200
    assert len(list((tmp_path / "t").rglob("*.parquet"))) < 400


def test_days_replaced_in_months(spark, rows, tmp_path):
    out, ddl = str(tmp_path / "t"), "n int, d date"
    days = [date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 2), date(2024, 3, 1), date(2023, 12, 31)]
    first = sinks.replace_days_in_months(rows([(i, d) for i, d in enumerate(days)], ddl), out, "d", days[0], days[0])
    assert first.count() == 6
    untouched = {f: f.stat().st_mtime_ns for m in (202312, 202403) for f in (tmp_path / "t" / f"ano_mes={m}").glob("*.parquet")}
    for _ in range(2):  # a repeat changes nothing; 1 February has no rows any more
        got = sinks.replace_days_in_months(rows([(9, days[1])], ddl), out, "d", days[1], days[2])
        assert sorted((r.n, r.d, r.ano_mes) for r in got.collect()) == [
            (0, days[0], 202401), (3, days[3], 202402), (4, days[4], 202403), (5, days[5], 202312), (9, days[1], 202401)]
    assert len(untouched) == 2 and all(f.stat().st_mtime_ns == t for f, t in untouched.items())
    got = sinks.replace_days_in_months(rows([], ddl), out, "d", days[4], days[4])  # a month without rows goes
    assert sorted(r.n for r in got.collect()) == [0, 3, 5, 9] and not (tmp_path / "t" / "ano_mes=202403").exists()
