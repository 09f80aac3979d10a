"""Large jobs done in parts: same results, nothing left behind."""

import gzip
import json
import shutil
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from catalog import files as catalog_files
from quitanda import session
from quitanda.plans import nightly, sales
from quitanda.session import conf
from quitanda.sources import sinks

NOW = "2024-03-01"
HEAD = "id_venda,cpf_cliente,data_venda,valor_total,custo"


def now():
    return F.lit(NOW).cast("timestamp")


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}


@pytest.fixture()
def people(spark, tmp_path):
    rows = [(f"{n:011d}", f"P {n}", "SP") for n in range(5)]
    spark.createDataFrame(rows, "cpf string, nome string, uf string").write.partitionBy("uf").parquet(str(tmp_path / "people"))
    return str(tmp_path / "people")


def put(folder, n, lines, head=HEAD):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / f"f{n}.csv.gz", "wt") if n % 2 else open(folder / f"f{n}.csv", "w") as f:
        f.write("\n".join([head, *lines]) + "\n")


def line(n):
    return f'{n},{n % 7:011d},{"sem data" if n % 9 == 0 else f"2024-0{n % 3 + 1}-05"},"{n},50",1'


def content(spark, path):
    return sorted(repr(r) for r in spark.read.parquet(path).drop("_source_file").collect())


def test_sales_job_in_parts(spark, people, tmp_path, monkeypatch):
    for n in range(12):
        put(tmp_path / "raw", n, [line(n * 10 + i) for i in range(10)])
    put(tmp_path / "raw", 12, [])
    put(tmp_path / "raw", 13, ["x"], head="lixo")
    put(tmp_path / "raw", 14, ['900,"00000000001\n",2024-01-05,7,1', "901,1,2024-01-05,abc,1"])
    seen, write = [], sales.write_sales
    monkeypatch.setattr(sales, "write_sales", lambda df, out: (write(df, out), seen.append(out)))
    whole = sales.run(spark, str(tmp_path / "raw"), people, str(tmp_path / "whole"), now())
    assert len(seen) == 1 and whole["lidos"] == 122 and whole["gravados"] == 121 and whole["arquivos_ignorados"] == 1
    monkeypatch.setattr(session, "ROWS_AT_ONCE", 50)
    for _ in range(2):  # a repeat replaces
        assert sales.run(spark, str(tmp_path / "raw"), people, str(tmp_path / "out"), now()) == whole
    assert len(seen) > 3 and content(spark, str(tmp_path / "out")) == content(spark, str(tmp_path / "whole"))
    assert not list((tmp_path / "out").glob(".novas*")) and (tmp_path / "out" / "_SUCCESS").exists()


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    df = spark.range(1000, numPartitions=4).withColumn("k", F.col("id") % 3)
    sinks.write_partitioned(df, str(tmp_path / "a"), ["k"])
    session.materialize(df.groupBy("k").count(), "teste")
    assert not shuffle_files(spark) - before
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1000


def test_no_valid_sale_is_counted(spark, people, tmp_path):
    put(tmp_path / "raw", 0, ["1,1,2024-01-05,abc,1"])
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        got = sales.run(spark, str(tmp_path / "raw"), people, str(tmp_path / "out"), now())
    assert (got["status"], got["lidos"], got["gravados"]) == ("SUCCESS", 1, 0)


def test_landed_sales_in_parts(spark, people, tmp_path, monkeypatch):
    for n in range(8):
        put(tmp_path / "raw" / "ano=2024" / "mes=01" / f"dia={10 + n % 2}", n, [line(n * 10 + i) for i in range(10)])
    seen, write = [], sales.write_sales
    monkeypatch.setattr(sales, "write_sales", lambda df, out: (write(df, out), seen.append(out)))
    for name, rows in (("whole", session.ROWS_AT_ONCE), ("out", 25)):
        monkeypatch.setattr(session, "ROWS_AT_ONCE", rows)
        for day in (10, 11, 10):
            d = date(2024, 1, day)
            got = sales.run_landed(spark, str(tmp_path / "raw"), people, str(tmp_path / name), now(), d, d)
            assert got["lidos"] == 40 and got["gravados"] == 40
    assert len(seen) > 6 and content(spark, str(tmp_path / "out")) == content(spark, str(tmp_path / "whole"))


def test_partitions_are_exchanged(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame(v, "a string, b string, n int")
    path, new = str(tmp_path / "t"), str(tmp_path / "t" / ".novas")
    sinks.write_partitioned(rows(("1", "1", 1), ("1", "2", 2), ("2", None, 3), ("3", "1", 4)), path, ["a", "b"])
    sinks.write_partitioned(rows(("1", "1", 10), ("4", None, 11)), f"{new}/0", ["a", "b"])
    sinks.write_partitioned(rows(("1", "1", 12), ("5", "1", 13)), f"{new}/1", ["a", "b"])
    sinks.exchange_partitions(spark, [f"{new}/0", f"{new}/1"], path, ["a", "b"], {("1", "1"), ("2", None), ("9", "9")})
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [2, 4, 10, 11, 12, 13]


def test_raw_sales_are_written_in_parts_and_compressed(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").collect())
    monkeypatch.setattr(session, "ROWS_AT_ONCE", 2000)
    text = spark.read.option("header", True).csv(catalog_files.raw_sales(spark, sf))
    assert sorted(int(r[0]) for r in text.select("id_pedido").collect()) == whole
    assert all(f.endswith(".csv.gz") for f in text.inputFiles())


def test_spans_hold_every_day(spark, monkeypatch):
    days = ["2024-01-02", "2024-01-02", "2024-01-05", "2024-01-06", "2024-01-09"]
    sold = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("timestamp").alias("data_venda"))
    start, end, day = date(2024, 1, 1), date(2024, 1, 31), F.to_date("data_venda")
    assert nightly.spans(sold, day, start, end) == [(start, end)] == nightly.spans(sold.limit(0), day, start, end)
    monkeypatch.setattr(session, "ROWS_AT_ONCE", 2)
    assert nightly.spans(sold, F.trunc(day, "month"), start, end) == [(start, end)]
    assert nightly.spans(sold, day, start, end) == [(start, date(2024, 1, 4)), (date(2024, 1, 5), date(2024, 1, 8)), (date(2024, 1, 9), end)]


def test_star_and_marts_in_spans(spark, tmp_path, monkeypatch):
    """Days next to each other, in two months, and a day without sales: as in one go."""
    folder = tmp_path / "raw" / "clientes"
    folder.mkdir(parents=True)
    people = [{"cpf": f"{n:011d}", "nome": f"P {n}", "uf": "SP", "segmento_cliente": "B2C", "data_cadastro": "2024-01-01"} for n in (1, 2)]
    (folder / "c.json").write_text(json.dumps({"clientes": people}))
    days = ["2024-01-30", "2024-01-31", "2024-01-31", "2024-02-01", "2024-02-03"]
    head = "id_venda,id_pedido,cpf_cliente,data_venda,produto_id,produto_nome,categoria_produto,valor_total,custo,desconto,canal_venda,status_venda,forma_pagamento,quantidade"
    put(tmp_path / "raw" / "vendas", 0, [f"{i},{i},{i % 2 + 1:011d},{d},P{i},p,c,{i + 1}0.00,1,0,ECOMMERCE,CONCLUIDA,PIX,1" for i, d in enumerate(days)], head)
    run = nightly.Run(datetime(2024, 2, 4, 3), date(2024, 1, 30), date(2024, 2, 3))
    lake, found = session.LakePaths(str(tmp_path)), []
    nightly.load_lake(spark, lake, run)
    for rows in (session.ROWS_AT_ONCE, 1, 1):  # again over what is there
        monkeypatch.setattr(session, "ROWS_AT_ONCE", rows)
        star = nightly.load_star(spark, lake, run)
        tables = star | nightly.load_marts(spark, lake, star, run)
        found.append({n: sorted(map(repr, t.select(sorted(t.columns)).collect())) for n, t in tables.items()})
        lake = lake if rows == 1 else session.LakePaths(str(tmp_path / "again"))
        if rows > 1:
            shutil.copytree(tmp_path / "processed", tmp_path / "again" / "processed")
    assert found[0] == found[1] == found[2] and len(found[0]["dm_vendas_diarias"]) == 4 and len(found[0]["dm_vendas_canal"]) == 2
