"""Privacy, retention and schema discovery."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import cpf_text, table
from quitanda.functions import privacy
from quitanda.operators import discovery, retention
from quitanda.session import scratch_path

AS_OF = "2001-08-02"


@query("mask_pii", """WITH d AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS t, lpad(CAST(c_custkey AS VARCHAR), 8, '3') AS n FROM customer)
SELECT c_custkey, sha256('sal' || t) AS cpf_hash, '***.' || t[4:6] || '.' || t[7:9] || '-**' AS cpf_mascara, '(11) 9****-****' AS telefone FROM d""")
def mask_pii(spark, sf):
    k = F.col("c_custkey")
    t, n = cpf_text(k), F.lpad(k.cast("string"), 8, "3")
    phone = F.concat(F.lit("(11) 9"), F.substring(n, 1, 4), F.lit("-"), F.substring(n, 5, 4))
    dotted = F.regexp_replace(t, r"(\d{3})(\d{3})(\d{3})(\d{2})", "$1.$2.$3-$4")
    return table(spark, sf, "customer").select(
        k, privacy.hash_cpf(dotted, "sal").alias("cpf_hash"), privacy.mask_cpf(dotted).alias("cpf_mascara"),
        privacy.mask_phone(phone).alias("telefone"))


@query("anonymize_ip", """SELECT event_id, '192.168.' || (user_id % 256) || '.xxx' AS ip FROM events""")
def anonymize_ip(spark, sf):
    ip = F.concat_ws(".", F.lit("192.168"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"))
    return table(spark, sf, "events").select("event_id", privacy.anonymize_ip(ip).alias("ip"))


@query("drop_sensitive", """SELECT event_id, '{"plano":"' || event_type || '"}' AS conta FROM events""")
def drop_sensitive(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("token"),
        F.struct(F.col("event_type").alias("plano"), F.col("value").alias("senha"), F.col("user_id").alias("credit_card")).alias("conta"))
    return privacy.drop_sensitive(e).withColumn("conta", F.to_json("conta"))


@query("anonymize_old", """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dia, lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS t, 'Cliente ' || o_custkey AS nome FROM orders)
SELECT o_orderkey, CASE WHEN dia < DATE '1996-08-02' THEN '***.' || t[4:6] || '.' || t[7:9] || '-**' ELSE t END AS cpf,
CASE WHEN dia < DATE '1996-08-02' THEN 'ANONIMIZADO' ELSE nome END AS nome FROM d""")
def anonymize_old(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("dia"), cpf_text(F.col("o_custkey")).alias("cpf"),
        F.concat(F.lit("Cliente "), F.col("o_custkey").cast("string")).alias("nome"))
    return privacy.anonymize_old(o, "dia", F.lit(date(2001, 8, 2))).drop("dia")


def objects(spark, sf):
    """One object per order: key by zone and date, size and time of writing."""
    k = F.col("o_orderkey")
    zone = F.element_at(F.array(F.lit("raw"), F.lit("processed"), F.lit("archived")), (k % 3 + 1).cast("int"))
    key = F.concat(zone, F.lit("/vendas/ano="), F.date_format("o_orderdate", "yyyy"), F.lit("/mes="),
                   F.date_format("o_orderdate", "MM"), F.lit("/p"), k.cast("string"), F.when(k % 3 == 1, ".parquet").otherwise(".json"))
    return table(spark, sf, "orders").select(
        key.alias("key"), F.floor("o_totalprice").alias("bytes"), F.col("o_orderdate").alias("modified"))


_OBJECTS = """objetos AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'processed' ELSE 'archived' END AS zona,
  'vendas/ano=' || strftime(o_orderdate, '%Y/mes=%m') || '/p' || o_orderkey || CASE WHEN o_orderkey % 3 = 1 THEN '.parquet' ELSE '.json' END AS resto,
  CAST(floor(o_totalprice) AS BIGINT) AS bytes, CAST(DATE '2001-08-02' - CAST(o_orderdate AS DATE) AS INTEGER) AS idade_dias FROM orders)"""
_PLAN = f"""{_OBJECTS}, plano AS (SELECT zona || '/' || resto AS key, bytes, idade_dias,
  CASE zona WHEN 'raw' THEN 'raw-dados-brutos' ELSE 'processed-dados-processados' END AS regra,
  CASE zona WHEN 'raw' THEN 90 ELSE 180 END - idade_dias AS dias_para_arquivar,
  CASE zona WHEN 'raw' THEN 820 ELSE 1275 END - idade_dias AS dias_para_deletar, resto FROM objetos WHERE zona <> 'archived'),
p AS (SELECT *, CASE WHEN dias_para_deletar <= 0 THEN 'deletar' WHEN dias_para_arquivar <= 0 THEN 'arquivar' ELSE 'manter' END AS acao FROM plano)"""


def _plan(spark, sf):
    return retention.retention_plan(objects(spark, sf), F.lit(AS_OF).cast("timestamp"))


@query("retention_plan", f"""WITH {_PLAN} SELECT key, bytes, regra, idade_dias, acao, dias_para_arquivar, dias_para_deletar,
CASE WHEN acao = 'arquivar' THEN 'archived/' || resto END AS nova_chave FROM p""")
def retention_plan(spark, sf):
    return _plan(spark, sf).drop("modified")


@query("retention_totals", f"WITH {_PLAN} SELECT regra, acao, COUNT(*) AS objetos, CAST(SUM(bytes) AS BIGINT) AS bytes FROM p GROUP BY 1, 2")
def retention_totals(spark, sf):
    return retention.retention_totals(_plan(spark, sf))


@query("due_soon", f"""WITH {_PLAN} SELECT key, CASE WHEN dias_para_arquivar > 0 AND dias_para_arquivar <= 60 THEN 'arquivar_em_breve' ELSE 'deletar_em_breve' END AS pendente
FROM p WHERE (dias_para_arquivar > 0 AND dias_para_arquivar <= 60) OR (dias_para_deletar > 0 AND dias_para_deletar <= 60)""")
def due_soon(spark, sf):
    return retention.due_soon(_plan(spark, sf), 60).select("key", "pendente")


@query("archived_expiry", f"""WITH {_OBJECTS} SELECT CASE WHEN idade_dias >= 730 THEN 'deletar' ELSE 'arquivar' END AS acao, COUNT(*) AS objetos FROM objetos WHERE zona = 'archived' GROUP BY 1""")
def archived_expiry(spark, sf):
    plan = retention.retention_plan(objects(spark, sf), F.lit(AS_OF).cast("timestamp"), retention.ARCHIVE_RULES)
    return plan.groupBy("acao").agg(F.count("*").alias("objetos"))


@query("archive_plan", f"""WITH {_OBJECTS} SELECT 'raw/' || resto AS key, 'archived/' || resto AS nova_chave, bytes FROM objetos WHERE zona = 'raw' AND idade_dias > 90""")
def archive_plan(spark, sf):
    return retention.archive_plan(objects(spark, sf), F.lit(AS_OF)).select("key", "nova_chave", "bytes")


@query("archive_totals", f"""WITH {_OBJECTS} SELECT COUNT(*) AS arquivos, round(CAST(SUM(bytes) AS DOUBLE) / 1048576.0, 4) AS total_mb FROM objetos WHERE zona = 'raw' AND idade_dias > 90""")
def archive_totals(spark, sf):
    out = retention.archive_totals(retention.archive_plan(objects(spark, sf), F.lit(AS_OF)))
    return out.withColumn("total_mb", F.round("total_mb", 4))


@query("expire_events", """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-21'""")
def expire_events(spark, sf):
    return retention.expire_rows(table(spark, sf, "events"), "ts", F.lit(date(2024, 1, 31)), 10).select("event_id", "ts")


@query("discover_types", """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, replace(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), '.', ',') AS b,
  CAST(o_orderdate AS VARCHAR) AS c, o_orderpriority AS d, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS e FROM orders)
SELECT 'a' AS coluna, CASE WHEN COUNT(TRY_CAST(a AS BIGINT)) = COUNT(a) THEN 'bigint' END AS tipo FROM t
UNION ALL SELECT 'b', CASE WHEN COUNT(TRY_CAST(replace(b, ',', '.') AS DOUBLE)) = COUNT(b) THEN 'double' END FROM t
UNION ALL SELECT 'c', CASE WHEN COUNT(TRY_CAST(c AS TIMESTAMP)) = COUNT(c) THEN 'timestamp' END FROM t
UNION ALL SELECT 'd', CASE WHEN COUNT(TRY_CAST(d AS TIMESTAMP)) < COUNT(d) THEN 'string' END FROM t
UNION ALL SELECT 'e', CASE WHEN COUNT(TRY_CAST(e AS DOUBLE)) = COUNT(e) THEN 'double' END FROM t""")
def discover_types(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = o.select(k.cast("string").alias("a"),
                    F.replace(F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("."), F.lit(",")).alias("b"),
                    F.col("o_orderdate").cast("string").alias("c"), F.col("o_orderpriority").alias("d"),
                    F.when(k % 2 == 0, c).otherwise(F.concat(c, F.lit(".5"))).alias("e"))
    return discovery.infer_types(text)


@query("discover_partitions", """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'processed' ELSE 'archived' END || '_vendas' AS tabela,
n AS nivel, CASE n WHEN 0 THEN 'ano' ELSE 'mes' END AS coluna, COUNT(*) AS objetos FROM orders, (SELECT unnest([0, 1]) AS n) GROUP BY ALL""")
def discover_partitions(spark, sf):
    return discovery.partition_keys(objects(spark, sf))


@query("crawl_catalog", f"""WITH {_OBJECTS} SELECT zona || '_vendas' AS tabela, zona || '/vendas/' AS localizacao,
CASE zona WHEN 'processed' THEN 'parquet' ELSE 'json' END AS formato, 'ano,mes' AS particoes, COUNT(*) AS arquivos, CAST(SUM(bytes) AS BIGINT) AS bytes FROM objetos GROUP BY 1, 2, 3""")
def crawl_catalog(spark, sf):
    return discovery.crawl(objects(spark, sf))


@query("merge_schemas", """SELECT 'pedidos' AS tabela, 'valor' AS coluna, CASE WHEN COUNT(*) FILTER (o_orderkey % 100 = 0) > 0 THEN 'string' ELSE 'double' END AS tipo FROM orders
UNION ALL SELECT 'pedidos', 'preco', 'double' FROM (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'pedidos', 'id', 'bigint' FROM (SELECT COUNT(*) FROM orders)""")
def merge_schemas(spark, sf):
    """Schemas of one file per order: each file saw its own type for the same column."""
    k = F.col("o_orderkey")
    seen = F.array(
        F.struct(F.lit("valor").alias("coluna"), F.when(k % 100 == 0, "string").when(k % 3 == 1, "double").otherwise("bigint").alias("tipo")),
        F.struct(F.lit("preco").alias("coluna"), F.when(k % 2 == 0, "double").otherwise("bigint").alias("tipo")),
        F.struct(F.lit("id").alias("coluna"), F.lit("bigint").alias("tipo")))
    per_file = table(spark, sf, "orders").select(F.lit("pedidos").alias("tabela"), F.explode(seen).alias("c")).select("tabela", "c.*")
    return discovery.merge_schemas(per_file)


def _described(name: str) -> str:
    kind = ("CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
            "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END")
    return (f"SELECT '{name}' AS tabela, column_name AS coluna, {kind} AS tipo, (SELECT COUNT(*) FROM {name}) AS linhas "
            f"FROM (DESCRIBE SELECT * FROM {name})")


@query("file_schemas", " UNION ALL ".join(map(_described, ("lineitem", "orders", "customer", "part", "events"))))
def file_schemas(spark, sf):
    """Columns and types of the files of five tables, from their own schemas, with their rows."""
    out = None
    for name in ("lineitem", "orders", "customer", "part", "events"):
        cols = discovery.columns_of(spark, f"{sf}/{name}.parquet", "parquet")
        shown = F.array(*[F.struct(F.lit(name).alias("tabela"), F.lit(c).alias("coluna"), F.lit(t).alias("tipo")) for c, t in cols])
        one = (table(spark, sf, name).agg(F.count("*").alias("linhas"))
               .select(F.explode(shown).alias("c"), "linhas").select("c.*", "linhas"))
        out = one if out is None else out.unionByName(one)
    return out


_CRAWLED = (
    ("raw_pedidos_novos", "csv", "o_orderkey:bigint o_totalprice:double o_orderdate:timestamp o_orderpriority:string ano:bigint", "orders"),
    ("raw_eventos", "json", "event_id:bigint event_type:string user_id:bigint", "events"),
    ("processed_clientes", "parquet", "c_custkey:bigint c_name:string c_mktsegment:string", "customer"),
)


@query("crawl_columns", " UNION ALL ".join(
    f"SELECT '{t}' AS tabela, '{f}' AS formato, '{c.split(':')[0]}' AS coluna, '{c.split(':')[1]}' AS tipo FROM (SELECT COUNT(*) FROM {source})"
    for t, f, cols, source in _CRAWLED for c in cols.split()))
def crawl_columns(spark, sf):
    """Tables of three formats written under one root, found again with their columns and types."""
    root = scratch_path(spark, "lago-varrido")
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority",
        F.year("o_orderdate").cast("string").alias("ano"))
    o.hint("rebalance", "ano").write.partitionBy("ano").option("header", True).csv(f"{root}/raw/pedidos-novos")
    table(spark, sf, "events").select("event_id", "event_type", "user_id").write.json(f"{root}/raw/eventos")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.parquet(f"{root}/processed/clientes")
    return discovery.crawl_columns(spark, root)
