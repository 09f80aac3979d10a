"""The chain end to end, its reruns, and the SQL surface over it."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quitanda.functions.dates import weekday_english
from quitanda.plans import marts, nightly, sales, sql
from quitanda.schemas import SALE_COLUMNS
from quitanda.session import LakePaths
from quitanda.sources import files


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def sale(n, cpf, day, value, product="P1", channel="ECOMMERCE", status="CONCLUIDA"):
    values = {"id_venda": n, "id_pedido": n, "cpf_cliente": cpf, "data_venda": day, "produto_id": product, "produto_nome": product,
              "categoria_produto": "c", "quantidade": 1, "desconto": "0", "valor_total": value, "custo": "1.00",
              "canal_venda": channel, "status_venda": status, "forma_pagamento": "PIX"}
    return ",".join(str(values.get(c, "")) for c in SALE_COLUMNS)


@pytest.fixture()
def lake(tmp_path):
    def arrive(people, sales):
        put(tmp_path / "raw" / "clientes", "c.json", json.dumps({"clientes": people}))
        put(tmp_path / "raw" / "vendas", "v.csv", "\n".join([",".join(SALE_COLUMNS), *sales]) + "\n")
        return LakePaths(str(tmp_path))

    return arrive


def person(n, **kw):
    return {"cpf": f"{n:011d}", "nome": f"P {n}", "uf": "SP", "cidade": "X", "segmento_cliente": "B2C", "data_cadastro": "2024-01-01", **kw}


def test_two_nights(spark, lake):
    a, b = f"{1:011d}", f"{2:011d}"
    first = [sale(1, a, "2024-01-09", "10.00"), sale(2, b, "2024-01-09", "20.00", channel="LOJA_FISICA"), sale(3, "99999999990", "2024-01-09", "5.00")]
    night1 = nightly.Run(datetime(2024, 1, 10, 3), date(2024, 1, 9), date(2024, 1, 10))
    t = nightly.run_all(spark, lake([person(1), person(2)], first), night1)
    assert t["fato_vendas"].count() == 2 and t["dim_clientes"].count() == 2

    second = [*first, sale(4, a, "2024-01-11", "30.00", product="P2")]
    where = lake([person(1, cidade="Y"), person(2)], second)
    night2 = nightly.Run(datetime(2024, 1, 11, 3), date(2024, 1, 11), date(2024, 1, 11))
    for _ in range(2):  # a rerun of the same batch changes nothing
        t = nightly.run_all(spark, where, night2)
        assert t["fato_vendas"].count() == 3 and t["dim_clientes"].count() == 3 and t["dim_produto"].count() == 2
        assert t["dim_tempo"].count() == 3
    top = {r.cpf: r for r in t["dm_top_clientes"].collect()}
    assert (top[a].total_pedidos, str(top[a].receita_total), top[a].ranking_receita) == (2, "40.00", 1)
    days = {r.data_venda.day: r for r in t["dm_vendas_diarias"].collect()}
    assert str(days[9].receita_total) == "30.00" and days[9].qtd_vendas_ecommerce == 1 and days[11].qtd_clientes_unicos == 1

    sql.publish(spark, where)
    share = {r.canal_venda: float(r.share_receita_pct) for r in spark.table("dm.vw_funil_canal").collect()}
    assert share == {"ECOMMERCE": 66.67, "LOJA_FISICA": 33.33}
    yoy = spark.table("dm.vw_receita_yoy").collect()
    assert len(yoy) == 1 and yoy[0].crescimento_yoy_pct is None
    assert spark.table("dm.vw_kpis_mes_atual").count() == 1
    assert spark.sql("SELECT uf_para_regiao('SP') AS r").first().r == "SUDESTE"
    names = spark.sql("SELECT c.nome FROM dw.fato_vendas f JOIN dw.dim_clientes c USING (sk_cliente) WHERE f.valor_total = 30").collect()
    assert [r.nome for r in names] == ["P 1"]


def landed(root, day, people, sales):
    where = f"ano={day[:4]}/mes={day[5:7]}/dia={day[8:]}"
    if people:
        put(root / "raw" / "clientes" / where, "c.json", json.dumps({"clientes": people}))
    if sales is not None:
        put(root / "raw" / "vendas" / where, "v.csv", "\n".join([",".join(SALE_COLUMNS), *sales]) + "\n")


def night(day, start, end, only=True):
    day = date.fromisoformat(day)
    return nightly.Run(datetime(day.year, day.month, day.day, 3), date.fromisoformat(start), date.fromisoformat(end), (day, day) if only else None)


def content(spark, lake):
    out = {}
    for name in ("clientes", "vendas"):
        df = spark.read.parquet(lake.processed(name))
        # a sale keeps what was known of its customer on the night it was loaded
        cols = sorted(c for c in df.columns if not c.startswith("_") and (name == "clientes" or c not in ("nome", "email", "uf", "cidade", "segmento_cliente")))
        out[name] = sorted(map(repr, df.select(cols).collect()))
    return out


def test_a_night_reads_its_night(spark, tmp_path):
    a, b, c = (f"{n:011d}" for n in (1, 2, 3))
    nights = {
        "2024-01-10": ([person(1), person(2)], [sale(1, a, "2024-01-09", "10.00"), sale(2, b, "2023-12-31", "20.00"), sale(9, a, "sem data", "1.00")]),
        "2024-01-11": ([person(1, uf="RJ", data_cadastro="2024-01-11"), person(3, data_cadastro="2023-01-01")],
                       [sale(3, a, "2024-01-10", "30.00"), sale(4, c, "2024-02-01", "5.00")]),
        "2024-01-12": ([person(3, cidade="old", data_cadastro="2020-01-01")], [sale(5, b, "2024-01-12", "7.00")])}
    one, many = LakePaths(str(tmp_path / "one")), LakePaths(str(tmp_path / "many"))
    for day, (people, sold) in nights.items():
        landed(tmp_path / "one", day, people, sold)
        landed(tmp_path / "many", day, people, sold)
    nightly.load_lake(spark, one, night("2024-01-12", "2023-12-31", "2024-02-01", only=False))
    for day in nights:
        for _ in range(2):  # a repeat changes nothing
            got = nightly.load_lake(spark, many, night(day, "2023-12-31", "2024-02-01"))
            assert [g["status"] for g in got] == ["SUCCESS"] * 2
    assert content(spark, many) == content(spark, one)
    kept = sales.kept_sales(spark, many.processed("vendas"), {("2024", "02"), (None, None)}, date(2024, 1, 12), date(2024, 1, 12))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [concat_ws" in plan and {r.id_venda for r in kept.collect()} == {"4", "9"}
    assert nightly.load_lake(spark, many, night("2024-01-20", "2024-01-01", "2024-02-01"))[1]["status"] == "SUCCESS_NO_DATA"

    # a landing day that comes again leaves the months it had touched before
    landed(tmp_path / "many", "2024-01-11", None, [sale(3, a, "2024-01-10", "31.00")])
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "many" / "processed" / "vendas" / "ano=2023").rglob("*.parquet")}
    nightly.load_lake(spark, many, night("2024-01-11", "2024-01-01", "2024-02-01"))
    left = {r.id_venda: str(r.valor_total) for r in spark.read.parquet(many.processed("vendas")).collect()}
    assert left == {"1": "10.00", "2": "20.00", "9": "1.00", "3": "31.00", "5": "7.00"}
    assert not (tmp_path / "many" / "processed" / "vendas" / "ano=2024" / "mes=02").exists()
    assert untouched and all(f.stat().st_mtime_ns == t for f, t in untouched.items())


def test_the_customer_mart_reads_only_the_range_of_the_fact(spark, tmp_path):
    a, b = f"{1:011d}", f"{2:011d}"
    lake = LakePaths(str(tmp_path))
    landed(tmp_path, "2023-12-05", [person(1), person(2)], [sale(1, a, "2023-12-04", "10.00"), sale(2, b, "2023-12-04", "20.00"), sale(3, a, "2023-12-05", "2.00")])
    landed(tmp_path, "2024-02-02", None, [sale(4, a, "2024-02-01", "30.00"), sale(5, b, "2024-02-01", "1.00", status="CANCELADA")])
    for run in (night("2023-12-05", "2023-12-04", "2023-12-05"), night("2024-02-02", "2024-02-01", "2024-02-01")):
        nightly.load_lake(spark, lake, run)
        star = nightly.load_star(spark, lake, run)
        if run.start.year == 2024:
            whole = marts.mart_customers_rfm(star["fato_vendas"], star["dim_clientes"], run.as_of).collect()
            for f in (tmp_path / "dw" / "fato_vendas").glob("dia=2023-*/*.parquet"):
                f.write_bytes(b"unreadable")
        found = nightly.load_marts(spark, lake, star, run)["dm_top_clientes"]
    got = found.drop("dm_atualizado_em", "dm_batch_id").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, whole)) and {(r.cpf, str(r.receita_total), r.total_pedidos) for r in got} == {(a, "42.00", 3), (b, "20.00", 1)}


def test_paged_api(spark, tmp_path):
    from quitanda.sources import api

    for page in range(5):
        put(tmp_path, f"p{page}.json", json.dumps({"vendas": [{"id": page * 2 + i, "valor": 1.5} for i in range(2)]}))
    for page in (5, 6):
        put(tmp_path, f"p{page}.json", json.dumps({"vendas": []}))
    api.register(spark)
    df = (spark.read.format("paged_json").schema("id long, valor double, canal string").option("records", "vendas")
          .option("partitions", "2").option("url", f"file://{tmp_path}/p{{page}}.json").load())
    assert sorted(r.id for r in df.collect()) == list(range(10))
    assert df.agg(F.sum("valor")).first()[0] == 15.0
    url = f"file://{tmp_path}/p{{page}}.json"
    reader = spark.read.format("paged_json").schema("id long").option("records", "vendas").option("url", url)
    assert reader.option("partitions", "4").option("pages", "5").load().count() == 10
    with pytest.raises(Exception, match="(?s)No such file|p7.json"):  # a page that is not there is an error, not the end
        reader.option("partitions", "4").option("pages", "9").load().count()


def test_hot_key_join_is_split(spark, rows):
    """A third of the sales share one CPF: AQE cuts that partition of the sort-merge join."""
    from quitanda.operators.joins import enrich_sales

    tuned = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in tuned}
    for k, v in tuned.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
        sales = spark.range(200_000, numPartitions=16).select("id", F.lpad(key.cast("string"), 11, "0").alias("cpf_cliente"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        people = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 11, "0").alias("cpf"), F.col("id").alias("n"))
        joined = enrich_sales(sales, people)
        joined.write.format("noop").mode("overwrite").save()
        counted = joined.groupBy("cpf_cliente").count()
        assert counted.where("cpf_cliente = '00000000007'").first()["count"] == 66_667 + 27
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_whole_range_is_that_of_the_orders(spark, tmp_path):
    from catalog import ORACLES, chain

    days = [datetime(1995, 3, 4), datetime(1998, 5, 6), datetime(2001, 12, 31)]
    orders = spark.createDataFrame([(d,) for d in days], "o_orderdate timestamp")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    run = chain.whole_range(spark, str(tmp_path))
    assert (run.start, run.end, run.now) == (date(1995, 3, 4), date(2001, 12, 31), datetime(2002, 1, 1, 3))
    assert not any("1998" in ORACLES[f"nightly_{x}"] for x in ("marts", "report"))


def test_landing_days_are_looked_up_as_text_before_the_pattern(spark):
    paths = ["s3a://x/ano=2024/mes=01/dia=10/f.csv", "s3a://x/ano=2024/mes=01/dia=11/a/f.csv", "s3a://x/ano=2024/mes=02/dia=10/f.csv", "s3a://x/f.csv", None,
             "s3a://x/ano=2023/mes=12/dia=31/a/ano=2024/mes=01/dia=10/f.csv"]  # the first day counts
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for first, last, want in ((date(2024, 1, 10), date(2024, 1, 11), [True, True, False, False, False, False]),
                              (date(2023, 12, 1), date(2024, 12, 31), [True, True, True, False, False, True])):
        assert [r[0] for r in df.select(files.landed_between(F.col("p"), first, last)).collect()] == want
    plan = df.where(~files.landed_between(F.col("p"), date(2024, 1, 10), date(2024, 1, 10)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains") < plan.index("regexp_extract")


def test_weekday_names(spark):
    got = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-08')) AS d UNION ALL SELECT NULL")
    assert got.where(~weekday_english(F.col("d")).eqNullSafe(F.date_format("d", "EEEE"))).count() == 0
