"""File jobs: Spark derives raw files from the tables, the library reads, cleans and writes them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import SALES, STATES_SQL, mean_sql, query, total_sql
from catalog.tables import cpf_text, sales, state_of, table
from quitanda.operators.aggregates import zone_stats
from quitanda.operators.rows import part_of
from quitanda.plans import customers as customer_job, daily, sales as sales_job
from quitanda.schemas import SALE_COLUMNS
from quitanda.session import parts_of, scratch_path, tidy
from quitanda.sources import files, sinks
from quitanda.sources.arrivals import csv_arrivals
from quitanda.sources.streams import keyed_messages

NOW = "2024-01-11 00:00:00"
ROWS_PER_FILE = 500_000  # a compressed file is read by one task


def _now():
    return F.lit(NOW).cast("timestamp")


def raw_customers(spark, sf) -> str:
    """Customer documents of up to 500 customers, one per line: lists in two envelopes, single
    objects, and a few malformed lines."""
    path = scratch_path(spark, "raw-clientes")
    k = F.col("c_custkey")
    one = F.struct(
        k.cast("string").alias("id"), cpf_text(k).alias("cpf"), F.upper("c_name").alias("nome"),
        F.concat(F.lit("c"), k.cast("string"), F.lit("@exemplo.com")).alias("email"),
        F.concat(F.lit(" "), F.lower(state_of(k))).alias("uf"), 
        F.concat(F.lit("2024-01-0"), (k % 9 + 1).cast("string")).alias("data_cadastro"),
        F.col("c_mktsegment").alias("segmento_cliente"), F.col("c_acctbal").cast("string").alias("limite_credito"))
    rows = table(spark, sf, "customer").select(k, one.alias("c"), F.floor(k / 500).alias("doc"))
    singles = rows.where(k % 50 == 7).select(F.to_json("c").alias("value"))
    stale = rows.where(k % 50 == 9).select(
        F.to_json(F.col("c").withField("data_cadastro", F.lit("2020-01-01"))).alias("value"))
    lists = rows.where(k % 50 != 7).groupBy("doc").agg(F.collect_list("c").alias("l"))
    wrapped = lists.select(F.when(F.col("doc") % 2 == 0, F.to_json(F.struct(F.col("l").alias("clientes"))))
                           .otherwise(F.to_json(F.struct(F.col("l").alias("data")))).alias("value"))
    broken = rows.where(k % 500 == 11).select(F.concat(F.lit('{"clientes": ['), k.cast("string")).alias("value"))
    singles.unionByName(stale).unionByName(wrapped).unionByName(broken).write.text(path)
    return path


@query("read_customers_json", """SELECT repetido, CAST(SUM(CASE WHEN repetido THEN 2 ELSE 1 END) AS BIGINT) AS linhas
FROM (SELECT c_custkey % 50 = 9 AS repetido FROM customer) GROUP BY 1""")
def read_customers_json(spark, sf):
    """Rows read from the documents, those repeated with an old date marked apart."""
    rows = files.customers_json(spark, raw_customers(spark, sf), _now(), multi_line=False)
    again = F.col("id").cast("bigint") % 50 == 9
    return rows.groupBy(again.alias("repetido")).agg(F.count("*").alias("linhas"))


@query("first_list_documents", """SELECT c_mktsegment AS segmento_cliente, COUNT(*) AS clientes FROM customer WHERE c_custkey % 50 <> 7 GROUP BY 1""")
def first_list_documents(spark, sf):
    """The lists inside the documents, found without knowing their key."""
    rows = files.first_list_json(spark, raw_customers(spark, sf), "cpf:string,segmento_cliente:string", multi_line=False)
    return rows.groupBy("segmento_cliente").agg(F.count("*").alias("clientes"))


@query("large_documents", """SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'clientes' ELSE 'data' END AS chave, c_mktsegment AS segmento_cliente,
  COUNT(*) AS clientes, CAST(SUM(CAST(c_acctbal AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS limite FROM customer GROUP BY 1, 2""")
def large_documents(spark, sf):
    """One document per nation, its customers one by one from the blocks of the file, whatever its size."""
    path, doc = scratch_path(spark, "documentos"), F.col("c_nationkey")
    key = F.when(doc % 2 == 0, "clientes").otherwise("data")
    tables = table(spark, sf, "customer")
    one = F.struct(cpf_text(F.col("c_custkey")).alias("cpf"), F.concat(F.lit('"{'), "c_name").alias("nome"), key.alias("cidade"),
                   F.col("c_mktsegment").alias("segmento_cliente"), F.col("c_acctbal").cast("string").alias("limite_credito"))
    members = tables.select(doc.alias("doc"), F.col("c_custkey").alias("place"), F.concat(F.to_json(one), F.lit(",")).alias("value"))
    nations = tables.select(doc.alias("doc"), key.alias("key")).distinct()
    ends = nations.select("doc", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("place"), F.concat(F.lit('{"total": {"n": [1]}, "'), "key", F.lit('": [')).alias("value")),
        F.struct(F.lit(2**63 - 1).alias("place"), F.lit('null], "fim": {}}').alias("value")))).alias("e")).select("doc", "e.*")
    (members.unionByName(ends).repartition("doc").sortWithinPartitions("doc", "place").select("doc", "value")
     .write.partitionBy("doc").text(path))
    return files.customers_json(spark, path, _now(), large=0).groupBy(F.col("cidade").alias("chave"), "segmento_cliente").agg(
        F.count("*").alias("clientes"), F.sum(F.col("limite_credito").cast("decimal(15,2)")).cast("decimal(25,2)").alias("limite"))


_DAY = "CAST('2024-01-0' || (c_custkey % 9 + 1) AS TIMESTAMP)"
_CLEAN = f"""SELECT c_custkey AS id, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cpf, upper(c_name[1]) || lower(c_name[2:]) AS nome,
  'c' || c_custkey || '@exemplo.com' AS email,
  {STATES_SQL}[c_custkey % 27 + 1] AS uf,
  {_DAY} AS data_cadastro, c_mktsegment AS segmento_cliente, CAST(c_acctbal AS DECIMAL(15,2)) AS limite_credito FROM customer WHERE c_custkey <> 0"""


@query("customer_job", _CLEAN)
def customer_job_output(spark, sf):
    """Raw documents through the whole customer job to partitioned Parquet and back."""
    out = scratch_path(spark, "processed-clientes")
    customer_job.run(spark, raw_customers(spark, sf), out, _now(), multi_line=False)
    return spark.read.parquet(out).select(
        "id", "cpf", "nome", "email", "uf", F.col("data_cadastro").cast("timestamp_ntz").alias("data_cadastro"),
        "segmento_cliente", "limite_credito")


@query("customer_partitions", f"SELECT uf, COUNT(*) AS clientes FROM ({_CLEAN}) GROUP BY 1")
def customer_partitions(spark, sf):
    """Two runs of the job: the second replaces, it does not add."""
    raw, out = raw_customers(spark, sf), scratch_path(spark, "processed-clientes")
    for _ in range(2):
        customer_job.run(spark, raw, out, _now(), multi_line=False)
    return spark.read.parquet(out).groupBy("uf").agg(F.count("*").alias("clientes"))


def sale_texts(spark, sf, part=0, parts=1):
    """Sales as text with Brazilian money, formatted CPFs and a few bad values; those of one part of the orders."""
    k = F.col("id_pedido")
    s = sales(spark, sf, "id_pedido", "sk_cliente", "produto_id", "produto_nome", "categoria_produto", "data_venda", "data_entrega",
              "quantidade", "desconto", "valor_total", "custo", "canal_venda", "status_venda", "forma_pagamento")
    local = lambda c: F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))
    dotted = F.regexp_replace(cpf_text(F.col("sk_cliente")), r"(\d{3})(\d{3})(\d{3})(\d{2})", "$1.$2.$3-$4")
    values = {
        "id_pedido": k.cast("string"), "cpf_cliente": dotted, "produto_id": F.col("produto_id").cast("string"),
        "data_venda": F.when(k % 500 != 5, F.date_format("data_venda", "yyyy-MM-dd HH:mm:ss")).otherwise("sem data"),
        "data_entrega": F.date_format("data_entrega", "yyyy-MM-dd"), "quantidade": F.col("quantidade").cast("string"),
        "desconto": local("desconto"), "custo": F.col("custo").cast("string"),
        "valor_total": F.when(k % 300 == 1, "abc").when(k % 300 == 2, "R$ -1,00").otherwise(local("valor_total")),
    }
    have = set(s.columns)
    cols = [(values.get(c) if c in values else (F.col(c) if c in have else F.lit(None).cast("string"))).alias(c) for c in SALE_COLUMNS]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if parts > 1:
        s = s.where(part_of(parts, "id_pedido") == part)
        tasks = max(-(-tasks // parts), min(tasks, spark.sparkContext.defaultParallelism))
    return s.repartition(tasks).select(*cols)


def write_sale_texts(spark, sf, path, **folders):
    """The sales as compressed CSV files, some of the orders at a time."""
    parts = parts_of(table(spark, sf, "lineitem").count())
    for i in range(parts):
        some = sale_texts(spark, sf, i, parts).withColumns(folders)
        with tidy(spark):
            (some.write.mode("append").option("header", True).option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE)
             .partitionBy(*folders).csv(path))


def raw_sales(spark, sf) -> str:
    """The sales as CSV files."""
    path = scratch_path(spark, "raw-vendas")
    write_sale_texts(spark, sf, path)
    return path


@query("quoted_notes", """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority || chr(10) || chr(10) || '  status "' || o_orderstatus || '", dia' || chr(10) || strftime(o_orderdate, '%Y-%m-%d') AS nota,
CAST(o_custkey AS VARCHAR) AS cliente FROM orders""")
def quoted_notes(spark, sf):
    """Orders as CSV with a note over four lines, quotes and commas in it, read back by name."""
    path = scratch_path(spark, "notas")
    note = F.concat("o_orderpriority", F.lit('\n\n  status "'), "o_orderstatus", F.lit('", dia\n'), F.date_format("o_orderdate", "yyyy-MM-dd"))
    (table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), note.alias("nota"), F.col("o_custkey").alias("cliente"))
     .write.option("header", True).option("escape", '"').csv(path))
    return csv_arrivals(spark, path).rows.select(*[F.col("record")[c].alias(c) for c in ("id", "nota", "cliente")])


def processed_lake(spark, sf) -> tuple[str, str]:
    """Both jobs over the raw files; the customers' and the sales' output paths."""
    people, sold = scratch_path(spark, "processed-clientes"), scratch_path(spark, "processed-vendas")
    customer_job.run(spark, raw_customers(spark, sf), people, _now(), multi_line=False)
    sales_job.run(spark, raw_sales(spark, sf), people, sold, _now())
    return people, sold


_SOLD = f"""{SALES}, limpo AS (SELECT id_pedido, sk_cliente, valor_total, desconto, custo, categoria_valor, margem_pct, canal_venda,
  CASE WHEN id_pedido % 500 <> 5 THEN data_venda END AS data_venda FROM sales WHERE id_pedido % 300 NOT IN (1, 2) AND valor_total > 0)"""


@query("sales_job", f"""WITH {_SOLD} SELECT year(data_venda)::VARCHAR AS ano, strftime(data_venda, '%m') AS mes, categoria_valor, COUNT(*) AS vendas,
{total_sql('valor_total')} AS receita, {total_sql('desconto')} AS desconto, {total_sql('custo')} AS custo,
CAST(SUM(margem_pct) AS DECIMAL(18,4)) AS margem, COUNT(*) FILTER (sk_cliente <> 0) AS com_cliente FROM limpo GROUP BY 1, 2, 3""")
def sales_job_output(spark, sf):
    """Raw CSV through the whole sales job to month partitions and back."""
    _, sold = processed_lake(spark, sf)
    return spark.read.parquet(sold).groupBy("ano", "mes", "categoria_valor").agg(
        F.count("*").alias("vendas"), F.sum("valor_total").cast("decimal(18,2)").alias("receita"),
        F.sum("desconto").cast("decimal(18,2)").alias("desconto"), F.sum("custo").cast("decimal(18,2)").alias("custo"),
        F.sum("margem_pct").cast("decimal(18,4)").alias("margem"), F.count("nome").alias("com_cliente"))


@query("sales_by_night", f"""WITH {_SOLD} SELECT year(data_venda)::VARCHAR AS ano, strftime(data_venda, '%m') AS mes, COUNT(*) AS vendas, {total_sql('valor_total')} AS receita,
{total_sql('desconto')} AS desconto, COUNT(*) FILTER (sk_cliente <> 0) AS com_cliente FROM limpo GROUP BY 1, 2""")
def sales_by_night(spark, sf):
    """The sales in folders of two landing days, loaded night by night, the first of them twice."""
    people, sold, raw = (scratch_path(spark, f"noites-{x}") for x in ("clientes", "vendas", "raw"))
    customer_job.run(spark, raw_customers(spark, sf), people, _now(), multi_line=False)
    day = F.lpad((F.col("id_pedido").cast("bigint") % 2 + 10).cast("string"), 2, "0")
    write_sale_texts(spark, sf, raw, ano=F.lit("2024"), mes=F.lit("01"), dia=day)
    for n in (10, 11, 10):
        night = date(2024, 1, n)
        sales_job.run_landed(spark, raw, people, sold, _now(), night, night)
    return spark.read.parquet(sold).groupBy("ano", "mes").agg(
        F.count("*").alias("vendas"), F.sum("valor_total").cast("decimal(18,2)").alias("receita"),
        F.sum("desconto").cast("decimal(18,2)").alias("desconto"), F.count("nome").alias("com_cliente"))


@query("month_partition", f"""WITH {_SOLD} SELECT CAST(data_venda AS DATE) AS data, COUNT(*) AS vendas FROM limpo
WHERE data_venda >= DATE '1998-03-01' AND data_venda < DATE '1998-04-01' GROUP BY 1""")
def month_partition(spark, sf):
    _, sold = processed_lake(spark, sf)
    return files.processed_sales(spark, sold, date(1998, 3, 10)).groupBy(F.to_date("data_venda").alias("data")).agg(
        F.count("*").alias("vendas"))


@query("daily_job", f"""WITH {_SOLD}, m AS (SELECT * FROM limpo WHERE data_venda >= DATE '1998-03-01' AND data_venda < DATE '1998-04-01')
SELECT strftime(data_venda, '%Y-%m-%d') AS data, COUNT(*) AS qtd_vendas, {total_sql('valor_total')} AS total_vendas, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio,
CASE WHEN sk_cliente <> 0 THEN {STATES_SQL}[sk_cliente % 27 + 1] END AS uf
FROM m GROUP BY 1, 5""")
def daily_job(spark, sf):
    """The daily job's JSON for one month, read back."""
    _, sold = processed_lake(spark, sf)
    out = scratch_path(spark, "agregacoes")
    daily.run(spark, sold, out, date(1998, 3, 10))
    ddl = "data string, uf string, qtd_vendas bigint, total_vendas decimal(18,2), ticket_medio decimal(15,2), data_ref string"
    return spark.read.schema(ddl).json(f"{out}/vendas_por_dia_uf").where("data_ref = '1998-03-10'").drop("data_ref")


_MONTH = f"""WITH {_SOLD}, m AS (SELECT *, lpad(CAST(sk_cliente AS VARCHAR), 11, '0') AS cpf FROM limpo WHERE data_venda >= DATE '1998-03-01' AND data_venda < DATE '1998-04-01')"""


def _daily_output(spark, sf, name: str, ddl: str):
    _, sold = processed_lake(spark, sf)
    out = scratch_path(spark, "agregacoes")
    daily.run(spark, sold, out, date(1998, 3, 10))
    return spark.read.schema(ddl + ", data_ref string").json(f"{out}/{name}").where("data_ref = '1998-03-10'").drop("data_ref")


@query("daily_job_customers", f"""{_MONTH}, t AS (SELECT cpf, COUNT(*) AS qtd_pedidos, {total_sql('valor_total')} AS total_gasto, {mean_sql('SUM(valor_total)', 'COUNT(*)')} AS ticket_medio FROM m GROUP BY 1)
SELECT cpf AS cpf_cliente, qtd_pedidos, total_gasto, ticket_medio, CAST(row_number() OVER (ORDER BY total_gasto DESC, cpf) AS INTEGER) AS ranking
FROM t ORDER BY total_gasto DESC, cpf LIMIT 100""")
def daily_job_customers(spark, sf):
    """The daily job's biggest spenders of one month, read back."""
    rows = _daily_output(spark, sf, "top_clientes", "cpf_cliente string, qtd_pedidos bigint, total_gasto decimal(18,2), ticket_medio decimal(15,2), ranking int")
    return rows.withColumn("cpf_cliente", F.translate("cpf_cliente", ".-", ""))


@query("daily_job_categories", f"""{_MONTH} SELECT strftime(data_venda, '%Y-%m') AS mes, categoria_valor, COUNT(*) AS qtd_vendas, {total_sql('valor_total')} AS total_vendas FROM m GROUP BY 1, 2""")
def daily_job_categories(spark, sf):
    """The daily job's value bands of one month, read back; product categories added up."""
    rows = _daily_output(spark, sf, "vendas_por_categoria", "mes string, categoria_valor string, qtd_vendas bigint, total_vendas decimal(18,2)")
    return rows.groupBy("mes", "categoria_valor").agg(F.sum("qtd_vendas").alias("qtd_vendas"), F.sum("total_vendas").cast("decimal(18,2)").alias("total_vendas"))


@query("expire_months", """SELECT strftime(o_orderdate, '%Y') AS ano, strftime(o_orderdate, '%m') AS mes, COUNT(*) AS pedidos, MIN(o_orderkey) AS primeiro FROM orders
WHERE o_orderdate >= DATE '1998-03-15' GROUP BY 1, 2""")
def expire_months(spark, sf):
    """Orders by month, expired twice up to a day inside a month."""
    path = scratch_path(spark, "expirar")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    sinks.write_partitioned(sinks.with_year_month(o, "o_orderdate"), path, ["ano", "mes"])
    for _ in range(2):
        sinks.expire_months(spark, path, "o_orderdate", date(1998, 3, 15))
    return spark.read.parquet(path).groupBy("ano", "mes").agg(F.count("*").alias("pedidos"), F.min("o_orderkey").alias("primeiro"))


@query("landed_events", """SELECT event_type, COUNT(*) AS eventos, MIN(event_id) AS primeiro FROM events GROUP BY 1""")
def landed_events(spark, sf):
    """Events as JSON lines in nested folders, read back in one batch."""
    path = scratch_path(spark, "eventos-jsonl")
    e = table(spark, sf, "events")
    (e.select(F.col("event_id").cast("string").alias("_id"), "event_type", F.date_format("ts", "yyyyMMdd").alias("pasta"))
     .hint("rebalance", "pasta").write.partitionBy("pasta").json(path))
    return files.events_jsonl(spark, path).groupBy("event_type").agg(F.count("*").alias("eventos"), F.min(F.col("_id").cast("bigint")).alias("primeiro"))


@query("land_raw", """SELECT event_id, user_id, event_type, value, props, strftime(ts, '%Y') AS ano, strftime(ts, '%m') AS mes, strftime(ts, '%d') AS dia FROM events""")
def land_raw(spark, sf):
    """Events as gzip JSON lines under their date, read back."""
    path = scratch_path(spark, "raw-eventos")
    e = table(spark, sf, "events").withColumn("data", F.to_date("ts")).hint("rebalance", "data")
    for _ in range(2):  # a rerun replaces its batch
        sinks.land_raw(e, path, F.col("data"), "B1")
    kept = "event_id bigint, user_id bigint, event_type string, value double, props string, ano string, mes string, dia string"
    return spark.read.schema(kept).json(path).drop("lote")


@query("product_catalog", """SELECT CAST(p_partkey AS VARCHAR) AS produto_id, p_name AS produto_nome FROM part""")
def product_catalog(spark, sf):
    path = scratch_path(spark, "catalogo")
    table(spark, sf, "part").select(F.col("p_partkey").alias("produto_id"), F.col("p_name").alias("produto_nome")).write.option("header", True).csv(path)
    return files.catalog_csv(spark, path, ("produto_id", "produto_nome"))


@query("landed_pages", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders WHERE o_orderdate > DATE '2000-01-01'""")
def landed_pages(spark, sf):
    path = scratch_path(spark, "api")
    table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at")).write.json(path)
    return files.landed_jsonl(spark, path, "o_orderkey bigint, updated_at string", "updated_at", "2000-01-01")


@query("raw_sql", """SELECT o_orderpriority AS canal, COUNT(*) AS vendas FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1 ORDER BY vendas DESC, canal LIMIT 3""")
def raw_sql(spark, sf):
    """Ad-hoc SQL over a partitioned raw table."""
    path = scratch_path(spark, "raw-sql")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("canal"), F.year("o_orderdate").cast("string").alias("ano"))
    sinks.write_partitioned(o, path, ["ano"])
    return files.raw_query(spark, spark.read.parquet(path), "raw_vendas",
                           "SELECT canal, COUNT(*) AS vendas FROM raw_vendas WHERE ano = '1997' GROUP BY canal ORDER BY vendas DESC, canal LIMIT 3")


@query("unload_query", """SELECT o_orderstatus, COUNT(*) AS pedidos FROM orders GROUP BY 1""")
def unload_query(spark, sf):
    path = scratch_path(spark, "unload")
    sinks.unload(table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("pedidos")), path)
    return spark.read.parquet(path)


@query("list_objects", """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'processed' ELSE 'archived' END AS zona,
CAST(SUM(octet_length(encode(o_orderkey || ';' || o_orderpriority)) + 1) AS BIGINT) AS bytes FROM orders GROUP BY 1""")
def list_objects(spark, sf):
    """Bytes per zone from the file listing, of orders written as text lines into three zones."""
    root = scratch_path(spark, "zonas")
    k = F.col("o_orderkey")
    lines = table(spark, sf, "orders").select(
        F.concat_ws(";", k.cast("string"), "o_orderpriority").alias("value"),
        F.when(k % 3 == 0, "raw").when(k % 3 == 1, "processed").otherwise("archived").alias("zona"))
    lines.write.partitionBy("zona").text(root)
    found = files.list_objects(spark, root, "*.txt")
    zone = F.regexp_extract("path", "/zona=([^/]+)/", 1)
    return zone_stats(found.withColumn("path", F.concat(zone, F.lit("/"), F.element_at(F.split("path", "/"), -1)))).drop("objetos")


@query("keyed_messages", """SELECT CAST(user_id AS VARCHAR) AS key, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type
|| '","cents":' || CAST(round(value * 100) AS BIGINT) || CASE WHEN props IS NULL THEN '' ELSE ',"props":' || CAST(to_json(props) AS VARCHAR) END || '}' AS value FROM events""")
def keyed_messages_of_users(spark, sf):
    e = table(spark, sf, "events")
    return keyed_messages(e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), "props"),
                          F.col("user_id"))
