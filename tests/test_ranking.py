"""Distributed numbering against plain Python, with a hot value."""

import statistics

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from quitanda.operators import aggregates, ranking, windows


def tiles(n, k):
    """SQL ntile by counting out the rows."""
    sizes = [n // k + (i < n % k) for i in range(k)]
    return [t + 1 for t, s in enumerate(sizes) for _ in range(s)]


@settings(max_examples=15, deadline=None)
@given(n=st.integers(1, 40), k=st.integers(1, 12))
def test_ntile_formula(spark, n, k):
    df = spark.range(1, n + 1)
    got = [r[0] for r in df.select(ranking.ntile_of(F.col("id"), F.lit(n), k)).collect()]
    assert got == tiles(n, k)


def skewed(spark, n=5000):
    """A third of the rows share one value."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * 7919) % 1000).alias("v"))


def test_numbering_spreads_a_hot_value(spark):
    df = skewed(spark)
    got = ranking.number_rows(df, [F.desc("v"), F.asc("id")], "pos", "total").collect()
    want = sorted(((r.v, r.id) for r in df.collect()), key=lambda t: (-t[0], t[1]))
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r.pos)] == want
    assert {r.total for r in got} == {5000} and sorted(r.pos for r in got) == list(range(1, 5001))
    blocks = ranking._blocks(df, [F.desc("v"), F.asc("id")], "t").groupBy("_block").count().collect()
    assert len(blocks) == 8 and max(b["count"] for b in blocks) < 5000 / 3


def test_running_sum(spark):
    df = skewed(spark, 997)
    got = sorted(ranking.running_sum(df, [F.asc("v"), F.asc("id")], "v", "run", "total", "pos").collect(), key=lambda r: r.pos)
    acc = 0
    for r in got:
        acc += r.v
        assert r.run == acc
    assert {r.total for r in got} == {acc}


def test_ntiles_of_several_orders_against_windows(spark):
    for n in (0, 1, 3, 7, 1003):
        df = spark.range(n).select(
            F.concat(F.lit("k"), (F.col("id") * 7919 % 1009).cast("string")).alias("k"), F.col("id").cast("int").alias("few"),
            F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 4).alias("hot"),
            F.when(F.col("id") % 5 > 0, (F.col("id") % 13).cast("decimal(12,2)")).alias("gaps"))
        got = ranking.with_ntiles(df, 5, "k", a=-F.col("few"), b=F.col("hot"), c=F.col("gaps"), d=F.lit(1))
        w = {"a": [F.desc("few")], "b": [F.asc("hot")], "c": [F.asc_nulls_first("gaps")], "d": []}
        want = df.withColumns({c: F.ntile(5).over(Window.orderBy(*o, F.asc("k"))) for c, o in w.items()})
        assert sorted(got.collect(), key=str) == sorted(want.select(*got.columns).collect(), key=str)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_quartiles_of_several_columns(spark):
    df = skewed(spark, 1001).select("*", (-F.col("id")).alias("w"), F.when(F.col("id") == 4, 2.5).alias("one"), F.lit(None).cast("int").alias("none"))
    got = {r.coluna: (r.p25, r.p50, r.p75, r.contagem) for r in aggregates.numeric_summary(df, ["v", "w", "one", "none"]).collect()}
    values = df.collect()
    for c in ("v", "w"):
        assert got[c] == (*statistics.quantiles(sorted(r[c] for r in values), n=4, method="inclusive"), 1001)
    assert got["one"] == (2.5, 2.5, 2.5, 1) and got["none"] == (None, None, None, 0)


def test_quartiles(spark):
    df = skewed(spark, 1001)
    values = sorted(r.v for r in df.collect())
    q = statistics.quantiles(values, n=4, method="inclusive")
    r = aggregates.numeric_summary(df, ["v"]).first()
    assert [r.p25, r.p50, r.p75] == q and r.contagem == 1001


def test_empty_table(spark):
    assert ranking.number_rows(spark.range(0), [F.asc("id")], "pos").count() == 0


def test_abc_small_catalogue(spark):
    df = spark.createDataFrame([(i, float(100 - i)) for i in range(20)], "produto_id int, receita_total double").withColumn(
        "receita_total", F.col("receita_total").cast("decimal(18,2)"))
    got = [r.classificacao_abc for r in windows.abc_class(df).orderBy("ranking").collect()]
    assert got == ["A"] * 4 + ["B"] * 6 + ["C"] * 10


def test_trailing_count_over_midnight(spark):
    base = 1704067200  # a midnight
    at = [base - 30, base - 30, base - 61, base, base + 29, base + 31]
    df = spark.createDataFrame([("x", t) for t in at], "event_type string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    got = {r.segundo - base: r.ultimos_segundos for r in windows.trailing_count(df).collect()}
    assert got == {s - base: sum(s - 60 <= t <= s for t in at) for s in set(at)}


def test_scratch_is_dropped(spark):
    import os

    from quitanda.session import drop_scratch, materialize

    kept = materialize(spark.range(3), "teste")
    folder = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(folder) and drop_scratch(spark) > 0 and not os.path.exists(folder)
