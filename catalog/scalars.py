"""Column functions over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import CALENDAR, SALES, STATES_SQL, exact, query, region_sql
from catalog.tables import cpf_text, order_calendar, sales, state_of, table
from quitanda.functions import dates, events, money, text
from quitanda.plans.calendar import calendar, days_of


@query("clean_cpf", """
WITH d AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS t FROM customer)
SELECT c_custkey, CASE WHEN c_custkey = 0 OR c_custkey % 50 IN (1, 2) THEN NULL ELSE t END AS cpf FROM d""")
def clean_cpf(spark, sf):
    k = F.col("c_custkey")
    t = cpf_text(k)
    dirty = (F.when(k % 50 == 1, "111.111.111-11").when(k % 50 == 2, F.substring(t, 1, 10))
             .when(k % 2 == 0, F.regexp_replace(t, r"(\d{3})(\d{3})(\d{3})(\d{2})", "$1.$2.$3-$4")).otherwise(t))
    return table(spark, sf, "customer").select(k, text.clean_cpf(dirty).alias("cpf"))


@query("clean_email", """
SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN 'c' || c_custkey || '@exemplo.com' WHEN 1 THEN ' c.' || c_custkey || '@x.org '
       ELSE NULL END AS email,
  c_custkey % 5 IN (0, 1) AS valido FROM customer""")
def clean_email(spark, sf):
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    dirty = (F.when(k % 5 == 0, F.concat(F.lit("c"), s, F.lit("@exemplo.com")))
             .when(k % 5 == 1, F.concat(F.lit(" c."), s, F.lit("@x.org ")))
             .when(k % 5 == 2, F.concat(F.lit("c"), s, F.lit("@x"))).when(k % 5 == 3, F.lit("a@b@c.com")))
    return table(spark, sf, "customer").select(
        k, text.clean_email(dirty).alias("email"), text.valid_email(dirty).alias("valido"))


@query("clean_name", r"""
WITH d AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' de ') AS nome FROM d""")
def clean_name(spark, sf):
    dirty = F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), F.lit("  DE "))), F.lit("  "))
    return table(spark, sf, "part").select("p_partkey", text.clean_name(dirty).alias("nome"))


@query("clean_phone", """
WITH d AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '3') AS n FROM customer)
SELECT c_custkey, CASE c_custkey % 4
  WHEN 0 THEN '(11) 9' || n[1:4] || '-' || n[5:8] WHEN 1 THEN '(21) ' || n[1:4] || '-' || n[5:8]
  WHEN 2 THEN '(11) 9' || n[1:4] || '-' || n[5:8] ELSE NULL END AS telefone FROM d""")
def clean_phone(spark, sf):
    k = F.col("c_custkey")
    n = F.lpad(k.cast("string"), 8, "3")
    dirty = (F.when(k % 4 == 0, F.concat(F.lit("119"), n)).when(k % 4 == 1, F.concat(F.lit("21"), n))
             .when(k % 4 == 2, F.concat(F.lit("(11) 9"), n)).otherwise(F.concat(F.lit("9"), n)))
    return table(spark, sf, "customer").select(k, text.clean_phone(dirty).alias("telefone"))


@query("clean_uf", f"""
SELECT c_custkey, CASE WHEN c_custkey % 11 = 5 THEN NULL ELSE {STATES_SQL}[c_custkey % 27 + 1] END AS uf FROM customer""")
def clean_uf(spark, sf):
    k = F.col("c_custkey")
    dirty = F.when(k % 11 == 5, "XX").otherwise(F.concat(F.lit(" "), F.lower(state_of(k)), F.lit(" ")))
    return table(spark, sf, "customer").select(k, text.clean_state(dirty).alias("uf"))


@query("uf_region", f"""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 28 = 27 THEN 'ZZ' ELSE {STATES_SQL}[c_custkey % 28 + 1] END AS uf FROM customer)
SELECT uf, {region_sql('uf')} AS regiao, COUNT(*) AS clientes FROM c GROUP BY 1, 2""")
def uf_region(spark, sf):
    k = F.col("c_custkey") % 28
    uf = F.when(k == 27, "ZZ").otherwise(state_of(k)).alias("uf")
    return (table(spark, sf, "customer").select(uf).groupBy("uf", text.region_of(F.col("uf")).alias("regiao"))
            .agg(F.count("*").alias("clientes")))


@query("clean_money", """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL
  ELSE CAST(o_totalprice AS DECIMAL(15,2)) END AS valor FROM orders""")
def clean_money(spark, sf):
    k, v = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(15,2)")
    local = F.translate(F.format_number(v, 2), ",.", ".,")
    plain = v.cast("string")
    dirty = (F.when(k % 8 == 0, F.concat(F.lit("R$ "), local)).when(k % 8 == 1, local).when(k % 8 == 2, plain)
             .when(k % 8 == 3, F.replace(plain, F.lit("."), F.lit(",")))
             .when(k % 8 == 4, F.concat(F.lit("R$ -"), local)).when(k % 8 == 5, "-").when(k % 8 == 6, "abc")
             .otherwise(F.concat(F.lit("R$"), plain)))
    return table(spark, sf, "orders").select(k, money.parse_money(dirty).alias("valor"))


@query("value_band", f"""WITH {SALES} SELECT categoria_valor, COUNT(*) AS qtd, MIN(valor_total) AS menor,
MAX(valor_total) AS maior FROM sales GROUP BY 1""")
def value_band(spark, sf):
    return sales(spark, sf, "categoria_valor", "valor_total").groupBy("categoria_valor").agg(
        F.count("*").alias("qtd"), F.min("valor_total").alias("menor"), F.max("valor_total").alias("maior"))


@query("margin_pct", f"""WITH {SALES} SELECT id_pedido, produto_id, valor_total, custo, margem_pct,
CAST(valor_total - custo AS DECIMAL(15,2)) AS margem_valor FROM sales""")
def margin_pct(spark, sf):
    s = sales(spark, sf, "id_pedido", "produto_id", "valor_total", "custo")
    v, c = F.col("valor_total"), F.col("custo")
    return s.withColumns({"margem_pct": money.margin_pct(v, c), "margem_valor": money.margin_value(v, c)})


@query("safe_ratio", f"""
SELECT o_orderkey, {exact('CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS HUGEINT)', '(o_orderkey % 5) * 100', 2, 'DECIMAL(15,2)')} AS razao FROM orders""")
def safe_ratio(spark, sf):
    v = F.col("o_totalprice").cast("decimal(15,2)")
    out = money.round2(money.ratio(v, (F.col("o_orderkey") % 5).cast("decimal(10,0)"))).cast("decimal(15,2)")
    return table(spark, sf, "orders").select("o_orderkey", out.alias("razao"))


@query("parse_fields", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE o_custkey END AS id,
  CASE WHEN o_orderkey % 6 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS nascimento,
  CASE WHEN o_orderkey % 6 = 3 THEN NULL ELSE o_orderdate + INTERVAL 90 MINUTE END AS cadastro FROM orders""")
def parse_fields(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    late = F.date_format(d.cast("timestamp") + F.expr("INTERVAL 90 MINUTE"), "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "orders").select(
        k, money.to_integer(F.when(k % 6 == 1, "n/d").otherwise(F.col("o_custkey").cast("string"))).alias("id"),
        dates.parse_date(F.when(k % 6 == 2, "31/12/1999").otherwise(F.date_format(d, "yyyy-MM-dd"))).alias("nascimento"),
        dates.parse_timestamp(F.when(k % 6 == 3, "ontem").otherwise(late)).cast("timestamp_ntz").alias("cadastro"))


@query("date_parts", """
SELECT o_orderkey, year(o_orderdate) AS ano, month(o_orderdate) AS mes, dayname(o_orderdate) AS dia_semana,
  CAST(o_orderdate AS DATE) AS dia, strftime(o_orderdate, '%Y-%m') AS rotulo_mes,
  strftime(o_orderdate, '%Y%m%d_%H') AS rotulo_hora, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS sk_tempo,
  strftime(o_orderdate, '%m') AS mes_pad, CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS dias,
  CAST(CAST(o_orderdate AS DATE) - 1 AS DATE) AS vespera FROM orders""")
def date_parts(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.year(d).cast("bigint").alias("ano"), F.month(d).cast("bigint").alias("mes"),
        dates.weekday_english(d).alias("dia_semana"), F.to_date(d).alias("dia"),
        dates.month_label(d).alias("rotulo_mes"), dates.hour_label(d).alias("rotulo_hora"),
        dates.date_key(d).alias("sk_tempo"), dates.two_digits(F.month(d)).alias("mes_pad"),
        dates.days_since(F.lit(date(2002, 1, 1)), d).alias("dias"), F.date_sub(F.to_date(d), 1).alias("vespera"))


@query("calendar_dim", f"WITH {CALENDAR} SELECT *, NOT fim_de_semana AS dia_util FROM calendario")
def calendar_dim(spark, sf):
    return order_calendar(spark, sf).drop("feriado_nacional", "feriado_nome", "ano_fiscal", "mes_fiscal")


@query("calendar_holidays", f"""WITH {CALENDAR},
f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS data_completa FROM orders
      WHERE strftime(o_orderdate, '%m-%d') IN ('01-01', '09-07', '12-25'))
SELECT c.sk_tempo, f.data_completa IS NOT NULL AS feriado_nacional,
  CASE strftime(f.data_completa, '%m') WHEN '01' THEN 'Confraternização' WHEN '09' THEN 'Independência' WHEN '12' THEN 'Natal' END AS feriado_nome,
  NOT fim_de_semana AND f.data_completa IS NULL AS dia_util,
  CAST(ano - CASE WHEN mes < 4 THEN 1 ELSE 0 END AS SMALLINT) AS ano_fiscal,
  CAST((mes + 8) % 12 + 1 AS SMALLINT) AS mes_fiscal
FROM calendario c LEFT JOIN f USING (data_completa)""")
def calendar_holidays(spark, sf):
    o = table(spark, sf, "orders")
    md = F.date_format("o_orderdate", "MM-dd")
    names = F.when(md == "01-01", "Confraternização").when(md == "09-07", "Independência").when(md == "12-25", "Natal")
    holidays = (o.select(F.to_date("o_orderdate").alias("data_completa"), names.alias("feriado_nome"))
                .where("feriado_nome is not null").distinct())
    return calendar(days_of(o, "o_orderdate"), holidays, fiscal_start=4).select(
        "sk_tempo", "feriado_nacional", "feriado_nome", "dia_util", "ano_fiscal", "mes_fiscal")


@query("age_bands", """
WITH d AS (SELECT c_custkey, DATE '1930-01-01' + CAST((c_custkey * 37) % 33000 AS INTEGER) AS n FROM customer),
a AS (SELECT c_custkey, date_diff('year', n, DATE '2024-06-30')
  - CASE WHEN strftime(n, '%m%d') > '0630' THEN 1 ELSE 0 END AS idade FROM d)
SELECT CASE WHEN idade >= 60 THEN '60+' WHEN idade >= 45 THEN '45-59' WHEN idade >= 35 THEN '35-44'
  WHEN idade >= 25 THEN '25-34' WHEN idade >= 18 THEN '18-24' ELSE '<18' END AS faixa_etaria,
  COUNT(*) AS clientes FROM a GROUP BY 1""")
def age_bands(spark, sf):
    birth = F.date_add(F.lit(date(1930, 1, 1)), ((F.col("c_custkey") * 37) % 33000).cast("int"))
    band = dates.age_band(birth, F.lit(date(2024, 6, 30)))
    return table(spark, sf, "customer").groupBy(band.alias("faixa_etaria")).agg(F.count("*").alias("clientes"))


@query("cpf_length", """
SELECT length(CAST(c_custkey AS VARCHAR) || '.000.000-00') BETWEEN 11 AND 14 AS tamanho_valido, COUNT(*) AS clientes
FROM customer GROUP BY 1""")
def cpf_length(spark, sf):
    t = F.concat(F.col("c_custkey").cast("string"), F.lit(".000.000-00"))
    return (table(spark, sf, "customer").groupBy(text.length_between(t, 11, 14).alias("tamanho_valido"))
            .agg(F.count("*").alias("clientes")))


@query("event_product", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'P' || regexp_extract(props, '[0-9]+') END AS produto FROM events""")
def event_product(spark, sf):
    k = F.col("event_id")
    id_ = F.concat(F.lit("P"), F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select(
        k, events.product_of(F.when(k % 3 == 0, id_).when(k % 3 == 1, ""), F.when(k % 3 == 1, id_)).alias("produto"))


@query("json_codec", """
SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS texto FROM events""")
def json_codec(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", events.decode_json(F.col("props"), "k int")["k"].alias("k"),
        events.encode_json(F.col("event_id"), F.col("event_type")).alias("texto"))


@query("content_hash", """
SELECT doc_id, md5(text) AS etag, sha256(text) AS token FROM documents""")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", events.etag(F.col("text")).alias("etag"), events.token(F.col("text")).alias("token"))
