"""Plans we rely on at scale."""

import io
import re
from contextlib import redirect_stdout
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog.tables import fact, order_calendar, sales, table
from quitanda.operators import joins, rows
from quitanda.operators.aggregates import channel_totals, share_of_total
from quitanda.operators.keyed import latest_per_key

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture()
def no_broadcast(spark):
    """Plan as for tables too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_needed_tables_and_columns_are_read(spark):
    text = plan(channel_totals(sales(spark, SF, "canal_venda", "id_pedido", "valor_total")))
    assert len(re.findall(r"\(\d+\) Scan parquet", text)) == 2
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text


def test_date_range_reaches_the_scan(spark):
    s = sales(spark, SF, "id_pedido", "valor_total", "data_venda")
    text = plan(rows.in_range(s, "data_venda", date(1996, 3, 1), date(1996, 4, 30)))
    assert "GreaterThanOrEqual(o_orderdate,1996-03-01T00:00)" in text and "LessThan(o_orderdate,1996-05-01T00:00)" in text


def test_calendar_is_broadcast_and_customers_are_not(spark, no_broadcast):
    f = fact(spark, SF, "sk_tempo", "sk_cliente", "valor_total")
    from catalog.tables import star_customers

    text = plan(joins.star(f, order_calendar(spark, SF), star_customers(spark, SF), ["ano"], ["uf"]))
    assert text.count("BroadcastHashJoin") >= 1 and "SortMergeJoin" in text


def test_daily_mart_aggregates_before_the_customer_join(spark, no_broadcast):
    from catalog.totals import daily_mart

    lines = plan(daily_mart(spark, SF)).split("\n\n")[0]
    tree = [ln for ln in lines.splitlines() if "Join" in ln or "HashAggregate" in ln]
    first_join = next(i for i, ln in enumerate(tree) if "SortMergeJoin" in ln)
    assert any("HashAggregate" in ln for ln in tree[first_join:])


@pytest.mark.parametrize("name", ["mart_daily", "mart_channel", "mart_customers", "sales_enriched", "fact_load", "rfm_scores",
                                  "abc_products", "scd2_customers", "customer_as_of", "validate_files", "trailing_count"])
def test_no_cross_join_and_no_python(spark, no_broadcast, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text


@pytest.mark.parametrize("name", ["mart_daily", "channel_funnel", "status_share", "product_share", "daily_growth", "share_in_month", "trailing_count"])
def test_no_window_over_one_partition(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert not spec.strip().startswith(("specifiedwindowframe", "_w0 ASC")), spec
    assert "[], [" not in "".join(re.findall(r"\) Window\n.*\n.*Arguments: (.*)", text))


def test_latest_per_key_is_a_partial_aggregate(spark):
    o = table(spark, SF, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    text = plan(latest_per_key(o, ["o_custkey"], ["o_orderdate"]))
    assert "partial_max" in text and "Window" not in text


def test_share_uses_a_scalar_subquery(spark):
    by = table(spark, SF, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    text = plan(share_of_total(by, "n", "pct"))
    assert "Subquery" in text and "Window" not in text


def test_checked_sales_are_joined_once(spark):
    """Two batches set aside and the clean rows read what was written, not the tables again."""
    assert "lineitem" not in plan(entry.queries()["quarantine_sales"](spark, SF))
