"""Star schema scenarios."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quitanda.operators import incremental, joins
from quitanda.operators.rows import current_rows
from quitanda.plans import marts, warehouse as dw
from quitanda.plans.nightly import Versions
from quitanda.plans.calendar import calendar, days_between, extend_calendar, stamp
from quitanda.session import materialize

STG = "cpf string, nome string, email string, telefone string, cidade string, uf string, segmento_cliente string, data_cadastro timestamp"
T0 = datetime(2024, 1, 1)
D1, D2 = date(2024, 1, 10), date(2024, 1, 11)


def person(cpf, nome="N", cidade="X", telefone="1", when=T0):
    return (cpf, nome, f"{cpf}@x.com", telefone, cidade, "SP", "B2C", when)


@pytest.fixture()
def loaded(spark, rows):
    one = rows([person("A"), person("B"), person("D", nome=None)], STG)
    two = rows([person("A", cidade="Y"), person("A", cidade="velha", when=datetime(2020, 1, 1)), person("B", telefone="2"),
                person("C"), person("D", nome="Dora")], STG)
    first = materialize(dw.scd2_customers(dw.empty_customer_dim(one, D1), one, D1), "t")
    second = materialize(dw.scd2_customers(first, two, D2), "t")
    return first, two, second


def test_scd2_versions(loaded):
    first, _, second = loaded
    assert [r.sk_cliente for r in first.orderBy("cpf").collect()] == [1, 2, 3]
    got = {(r.cpf, r.registro_atual): r for r in second.collect()}
    assert len(got) == 6 and second.count() == 6
    assert got["A", False].data_fim_vigencia == D1 and got["A", False].cidade == "X"
    assert got["A", True].cidade == "Y" and got["A", True].data_inicio_vigencia == D2
    assert got["B", True].telefone == "1" and ("B", False) not in got
    assert got["D", True].nome == "Dora" and got["D", False].nome is None
    assert sorted(r.sk_cliente for r in second.collect()) == [1, 2, 3, 4, 5, 6]
    assert got["A", True].regiao == "SUDESTE"


def test_scd2_repeat_adds_nothing(loaded):
    _, two, second = loaded
    again = dw.scd2_customers(second, two, D2)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, second.collect()))


def test_scd2_same_day_change_replaces(loaded, rows):
    _, _, second = loaded
    again = dw.scd2_customers(second, rows([person("A", cidade="Z")], STG), D2).where("cpf = 'A'")
    assert sorted((r.cidade, r.registro_atual, r.sk_cliente) for r in again.collect()) == [("X", False, 1), ("Z", True, 4)]


FACT = ("sk_cliente long, sk_tempo int, data_venda timestamp, valor_total decimal(15,2), desconto decimal(15,2), custo decimal(15,2), "
        "margem_pct decimal(18,4), canal_venda string, status_venda string")


def sale(sk, day, value, status="CONCLUIDA"):
    d = Decimal(value)
    return (sk, 20240100 + day, datetime(2024, 1, day, 9), d, Decimal(0), None, None, "ECOMMERCE", status)


def test_customer_mart_after_a_change(spark, rows, loaded):
    _, _, dim = loaded
    fact = rows([sale(1, 9, "10"), sale(1, 9, "20"), sale(4, 11, "30"), sale(2, 11, "5"), sale(2, 11, "99", "CANCELADA")], FACT)
    got = {r.cpf: r for r in marts.mart_customers(fact, dim, date(2024, 2, 1)).collect()}
    a = got["A"]
    assert (a.total_pedidos, str(a.receita_total), a.ranking_receita, a.dias_desde_ultima) == (3, "60.00", 1, 21)
    assert got["B"].total_pedidos == 1 and "C" not in got


def test_daily_mart_counts_people_not_versions(spark, rows, loaded):
    _, _, dim = loaded
    cal = calendar(days_between(spark, date(2024, 1, 1), date(2024, 1, 31)))
    fact = rows([sale(1, 11, "10"), sale(4, 11, "20"), sale(2, 11, "0.01"), sale(2, 12, "7")], FACT)
    mart = {r.data_venda.day: r for r in marts.mart_daily_with_growth(fact, cal, dim).collect()}
    assert mart[11].qtd_clientes_unicos == 2 and mart[11].qtd_vendas == 3 and str(mart[11].ticket_medio) == "10.00"
    assert str(mart[11].margem_total) == "0.00" and mart[11].receita_dia_anterior is None
    assert str(mart[12].receita_dia_anterior) == "30.01" and str(mart[12].crescimento_pct) == "-76.6700"


def test_fact_rows(spark, rows, loaded):
    _, _, dim = loaded
    stg = rows([("A", "P1", datetime(2024, 1, 11, 23), Decimal("10"), None, None), ("Q", "P1", datetime(2024, 1, 11), Decimal("10"), None, None),
                ("A", "P9", datetime(2024, 1, 12), Decimal("10"), 3, "PENDENTE"), ("A", None, datetime(2024, 1, 12), Decimal("1"), 3, None),
                ("A", "P1", datetime(2024, 1, 12), Decimal("0"), 1, None), ("A", "P1", datetime(2024, 1, 13), Decimal("9"), 1, None)],
               "cpf_cliente string, produto_id string, data_venda timestamp, valor_total decimal(15,2), quantidade int, status_venda string")
    products = rows([("P1", 7, True), ("P9", 8, False)], "produto_id string, sk_produto long, registro_atual boolean")
    cal = calendar(days_between(spark, date(2024, 1, 1), date(2024, 1, 31)))
    got = dw.fact_rows(stg, dim, products, cal, date(2024, 1, 11), date(2024, 1, 12), F.lit(T0), "B1")
    out = sorted((r.sk_cliente, r.sk_produto or 0, r.quantidade, r.status_venda) for r in got.collect())
    assert out == [(4, 0, 3, "CONCLUIDA"), (4, 0, 3, "PENDENTE"), (4, 7, 1, "CONCLUIDA")]
    assert dw.orphan_count(stg, dim, date(2024, 1, 11), date(2024, 1, 12)).first().sem_cliente == 1
    assert joins.orphan_sales(stg, dim).count() == 1


def test_products_are_inserted_once(spark, rows):
    stg = rows([("P1", "a", "x"), ("P1", "a", "x"), ("P2", "b", "x"), (None, "c", "x")], "produto_id string, produto_nome string, categoria_produto string")
    first = materialize(dw.load_products(dw.empty_product_dim(stg, D1), stg, D1), "t")
    renamed = stg.withColumn("produto_nome", F.lit("outro"))
    again = dw.load_products(first, renamed, D2)
    assert sorted((r.sk_produto, r.produto_id, r.produto_nome) for r in again.collect()) == [(1, "P1", "a"), (2, "P2", "b")]


def test_two_spellings_are_one_product(spark, rows):
    kind = "produto_id string, produto_nome string, categoria_produto string, data_venda timestamp"
    stg = rows([("P1", "Mesa", "x", T0), ("P1", "MESA", "x", datetime(2024, 1, 5)), ("P2", "b", "x", None)], kind)
    got = dw.load_products(dw.empty_product_dim(stg, D1), stg, D1).collect()
    assert sorted((r.sk_produto, r.produto_id, r.produto_nome) for r in got) == [(1, "P1", "MESA"), (2, "P2", "b")]


def test_refused_staging_leaves_the_old_one(spark, rows, tmp_path):
    path = str(tmp_path / "stg")
    dw.stage_customers(rows([("1",)], "cpf string"), F.lit(T0), "B1", path)
    with pytest.raises(ValueError):
        dw.stage_customers(rows([(None,)], "cpf string"), F.lit(T0), "B2", path)
    assert [r.cpf for r in spark.read.parquet(path).collect()] == ["1"]


def test_versions_survive_a_crash(spark, rows, tmp_path):
    store = Versions(spark, str(tmp_path / "dim"), keep=2)
    assert store.read() is None
    store.write(rows([(1,)], "n int"), "B1")
    store.write(rows([(2,)], "n int"), "B2")
    again = store.write(rows([(3,)], "n int"), "B2")  # a rerun: another folder, from the version before the batch
    assert again.first().n == 3 and store.read("B2").first().n == 1 and store.read().first().n == 3
    (tmp_path / "dim" / "v=00000009-B3").mkdir()  # a load that died
    assert store.read().first().n == 3
    assert store.write(rows([(4,)], "n int"), "B3").first().n == 4 and store.read("B3").first().n == 3


def test_staging(spark, rows, tmp_path):
    with pytest.raises(ValueError):
        dw.stage_customers(rows([(None,)], "cpf string"), F.lit(T0), "B1", str(tmp_path / "stg"))
    assert dw.stage_customers(rows([("1",)], "cpf string"), F.lit(T0), "B1", str(tmp_path / "stg")).count() == 1


def test_calendar_extends_once(spark):
    a = calendar(days_between(spark, date(2024, 1, 1), date(2024, 1, 10)))
    b = calendar(days_between(spark, date(2024, 1, 5), date(2024, 1, 15)))
    assert extend_calendar(extend_calendar(a, b), b).count() == 15
    assert "dw_criado_em" in stamp(a, F.lit(T0)).columns


def test_incremental_append_without_news(spark, rows, tmp_path):
    target = str(tmp_path / "t")
    src = rows([(1,), (2,)], "n int")
    assert incremental.incremental_append(spark, src, target, "n", "B1") == 2
    assert incremental.incremental_append(spark, src, target, "n", "B1") == 2
    assert incremental.incremental_append(spark, src, target, "n", "B2") == 2
    assert spark.read.parquet(target).count() == 2
    assert incremental.incremental_append(spark, rows([(2,), (3,)], "n int"), target, "n", "B2") == 3
    assert sorted(r.n for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_customer_as_of(spark, rows):
    dim = rows([("A", date(2024, 1, 1), date(2024, 1, 9), "x"), ("A", date(2024, 1, 10), None, "y")],
               "cpf string, data_inicio_vigencia date, data_fim_vigencia date, cidade string")
    fact = rows([("A", date(2024, 1, 9)), ("A", date(2024, 1, 10)), ("A", date(2023, 1, 1)), ("B", date(2024, 1, 9))], "cpf string, dia date")
    got = {(r.cpf, r.dia.year, r.dia.day): r.cidade for r in joins.as_of_dim(fact, dim, "cpf", "dia").collect()}
    assert got == {("A", 2024, 9): "x", ("A", 2024, 10): "y", ("A", 2023, 1): None, ("B", 2024, 9): None}


def test_current_rows(loaded):
    assert current_rows(loaded[2]).count() == 4
