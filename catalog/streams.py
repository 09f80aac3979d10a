"""Streaming queries: the events table is read as a file stream until it is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import shape_events, table
from quitanda.functions.events import product_of
from quitanda.schemas import SALE_MESSAGE
from quitanda.session import scratch_path
from quitanda.sources.streams import arriving_files, decode_events, keyed_messages
from quitanda.sources.versions import DayVersions
from quitanda.streaming import dead_letters, metrics, writers

_KIND = """CASE event_type WHEN 'purchase' THEN 'PURCHASE_COMPLETED' WHEN 'view' THEN 'PRODUCT_VIEW'
WHEN 'click' THEN 'BUTTON_CLICK' ELSE 'PAGE_VIEW' END"""
LATE = "1 day"  # events later than that are not counted
_PRODUCT = "'P' || regexp_extract(props, '[0-9]+')"


def raw_stream(spark, sf, name: str = "events", per_trigger: int | None = None):
    schema = table(spark, sf, name).schema
    return arriving_files(spark, sf, schema, "parquet", f"{name}.parquet", per_trigger)


def event_stream(spark, sf, watermark: str | None = None):
    return metrics.with_event_time(shape_events(raw_stream(spark, sf)), watermark=watermark)


def product():
    return product_of(F.col("propriedade_produto"), F.col("produto_comprado"))


def snapshot(spark, metric, label: str):
    """Run to the end in complete mode and read the last snapshot."""
    out = scratch_path(spark, label)
    writers.write_snapshot(metric, out, scratch_path(spark, f"{label}-ckpt"))
    return spark.read.parquet(out)


def by_day(spark, metric, label: str, keys: list[str], day: str = "inicio"):
    """Run to the end in update mode, watermarked, and read the table by day."""
    out = scratch_path(spark, label)
    writers.write_days(metric, out, scratch_path(spark, f"{label}-ckpt"), keys, day)
    return DayVersions(spark, out).read().select(*metric.columns)


@query("stream_counts", f"SELECT {_KIND} AS event_type, COUNT(*) AS eventos FROM events GROUP BY 1")
def stream_counts(spark, sf):
    return snapshot(spark, metrics.stream_counts(event_stream(spark, sf)), "contagem")


def _times(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("inicio", "fim")})


@query("stream_minute", """SELECT date_trunc('minute', ts) AS inicio, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS fim, COUNT(*) AS eventos FROM events GROUP BY 1, 2""")
def stream_minute(spark, sf):
    return _times(by_day(spark, metrics.stream_minute(event_stream(spark, sf, LATE)), "minuto", ["inicio"]))


@query("stream_sliding", f"""WITH e AS (SELECT {_KIND} AS event_type, ts, unnest([0, 1, 2, 3]) AS n FROM events),
w AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * n AS inicio FROM e)
SELECT event_type, inicio, inicio + INTERVAL 1 HOUR AS fim, COUNT(*) AS eventos FROM w GROUP BY 1, 2, 3""")
def stream_sliding(spark, sf):
    return _times(by_day(spark, metrics.stream_sliding(event_stream(spark, sf, LATE), "1 hour", "15 minutes"), "deslizante", ["inicio", "event_type"]))


@query("stream_revenue", """SELECT CAST(ts AS DATE) AS dia, CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(15,2)) ELSE 0 END) AS DECIMAL(18,2)) AS receita FROM events GROUP BY 1""")
def stream_revenue(spark, sf):
    return by_day(spark, metrics.stream_revenue(event_stream(spark, sf, LATE)), "receita", ["dia"], "dia")


@query("stream_top", f"SELECT {_PRODUCT} AS produto, COUNT(*) AS qtd FROM events GROUP BY 1 ORDER BY qtd DESC, produto LIMIT 5")
def stream_top(spark, sf):
    return snapshot(spark, metrics.stream_top(event_stream(spark, sf), product()), "top")


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS nova FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, SUM(nova) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, MIN(ts) AS inicio, MAX(ts) + INTERVAL 12 HOUR AS fim, COUNT(*) AS eventos FROM s GROUP BY user_id, n""")
def stream_sessions(spark, sf):
    return _times(snapshot(spark, metrics.stream_sessions(event_stream(spark, sf), "12 hours"), "sessoes"))


@query("session_counts", """SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, COUNT(*) AS eventos FROM events GROUP BY 1""")
def session_counts(spark, sf):
    return snapshot(spark, metrics.session_counts(event_stream(spark, sf)), "por-sessao")


@query("stream_dedup", "SELECT CAST(event_id AS VARCHAR) AS _id, ts AS timestamp FROM events")
def stream_dedup(spark, sf):
    """Every event delivered twice, kept once."""
    e = event_stream(spark, sf, "40 days").select("_id", "timestamp")
    twice = e.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("vez")).drop("vez")
    out = scratch_path(spark, "unicos")
    writers.write_append(metrics.dedup_events(twice), out, scratch_path(spark, "unicos-ckpt"))
    return spark.read.parquet(out).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("minute_drops", """WITH m AS (SELECT date_trunc('minute', ts) AS inicio, COUNT(*) AS eventos FROM events GROUP BY 1)
SELECT a.inicio, a.eventos, b.eventos AS minuto_anterior FROM m a JOIN m b ON b.inicio = a.inicio - INTERVAL 1 MINUTE WHERE a.eventos < b.eventos * 0.8""")
def minute_drops(spark, sf):
    minutes = by_day(spark, metrics.stream_minute(event_stream(spark, sf, LATE)), "minuto", ["inicio"])
    return metrics.drop_alert(minutes, 0.8).withColumn("inicio", F.col("inicio").cast("timestamp_ntz"))


@query("event_dashboard", f"""WITH e AS (SELECT {_KIND} AS tipo, {_PRODUCT} AS produto, ts, CAST(value AS DECIMAL(15,2)) AS v FROM events)
SELECT 'total_eventos' AS metrica, NULL AS item, CAST(COUNT(*) AS DECIMAL(18,2)) AS valor FROM e
UNION ALL SELECT 'receita_acumulada', NULL, CAST(SUM(CASE WHEN tipo = 'PURCHASE_COMPLETED' THEN v ELSE 0 END) AS DECIMAL(18,2)) FROM e
UNION ALL SELECT 'eventos_ultimo_minuto', NULL, CAST(COUNT(*) FILTER (ts > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 1 MINUTE) AS DECIMAL(18,2)) FROM e
UNION ALL SELECT 'eventos_por_tipo', tipo, CAST(COUNT(*) AS DECIMAL(18,2)) FROM e GROUP BY 2
UNION ALL SELECT 'top_produtos', produto, q FROM (SELECT produto, CAST(COUNT(*) AS DECIMAL(18,2)) AS q FROM e GROUP BY 1 ORDER BY q DESC, produto LIMIT 5)""")
def event_dashboard(spark, sf):
    """The stored stream turned into dashboard rows."""
    as_of = F.lit("2024-01-30 23:00:00")
    return metrics.dashboard(metrics.with_event_time(shape_events(table(spark, sf, "events"))), product(), as_of)


@query("stream_raw_events", f"SELECT {_KIND} AS tipo, strftime(ts, '%Y%m%d_%H') AS hora, COUNT(*) AS eventos FROM events GROUP BY 1, 2")
def stream_raw_events(spark, sf):
    """JSON lines by type and hour, written by the stream and read back."""
    out = scratch_path(spark, "raw-eventos")
    writers.write_raw_events(event_stream(spark, sf), out, scratch_path(spark, "raw-eventos-ckpt"))
    return (spark.read.schema("_id string, tipo string, hora string").json(out)
            .groupBy("tipo", "hora").agg(F.count("_id").alias("eventos")))


@query("decode_messages", f"SELECT CAST(event_id AS VARCHAR) AS _id, {_KIND} AS event_type, CAST(user_id AS VARCHAR) AS user_id, value AS valor_total FROM events")
def decode_messages(spark, sf):
    """Events encoded as keyed JSON messages and decoded with the event schema."""
    e = shape_events(table(spark, sf, "events")).select(
        "_id", "event_type", F.col("user_id").cast("string").alias("user_id"), F.col("valor_total").cast("double").alias("valor_total"))
    return decode_events(keyed_messages(e, F.col("user_id"))).select("_id", "event_type", "user_id", "valor_total")


def message_stream(spark, sf):
    """Sale messages: some without customer, some not JSON, some tried before."""
    k = F.col("o_orderkey")
    body = F.struct(
        k.cast("string").alias("id_venda"), F.when(k % 10 != 1, F.col("o_custkey").cast("string")).alias("cpf_cliente"),
        F.col("o_totalprice").alias("valor_total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("data_venda"))
    text = F.when(k % 10 == 2, F.concat(F.lit("{nao json "), k.cast("string"))).otherwise(F.to_json(body))
    return raw_stream(spark, sf, "orders").select(text.alias("value"), (k % 3).cast("int").alias("tentativas"))


@query("stream_dead_letters", """WITH m AS (SELECT o_orderkey % 10 IN (1, 2) AS ruim, o_orderkey % 3 + 1 AS tentativas FROM orders)
SELECT 'ok' AS rota, COUNT(*) AS mensagens FROM m WHERE NOT ruim UNION ALL
SELECT 'repetir', COUNT(*) FROM m WHERE ruim AND tentativas < 3 UNION ALL SELECT 'dlq', COUNT(*) FROM m WHERE ruim AND tentativas >= 3
UNION ALL SELECT 'reenviadas', COUNT(*) FROM m WHERE ruim AND tentativas >= 3""")
def stream_dead_letters(spark, sf):
    paths = [scratch_path(spark, f"mensagens-{r}") for r in ("ok", "repetir", "dlq")]
    stream = message_stream(spark, sf)
    writers.finish(stream.writeStream.option("checkpointLocation", scratch_path(spark, "mensagens-ckpt"))
                   .foreachBatch(dead_letters.route_dead_letters(*paths)))
    left = "value string, tentativas int, erros array<string>, lote string"
    schemas = [f"{SALE_MESSAGE}, lote string", left, left]
    read = dict(zip(("ok", "repetir", "dlq"), (spark.read.schema(s).parquet(p) for s, p in zip(schemas, paths))))
    read["reenviadas"] = dead_letters.redrive(read["dlq"])
    counts = [df.agg(F.lit(r).alias("rota"), F.count("*").alias("mensagens")) for r, df in read.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("stream_validation", """WITH f AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (o_orderkey % 10 = 1) AS ruim FROM orders)
SELECT FALSE AS valido, n AS total_registros, ruim AS registros_invalidos, n AS em_quarentena FROM f""")
def stream_validation(spark, sf):
    """A file that arrives with null totals goes to quarantine as a whole."""
    k = F.col("o_orderkey")
    arrived = raw_stream(spark, sf, "orders").select(
        k.alias("id_venda"), F.col("o_custkey").alias("cpf_cliente"), F.when(k % 10 != 1, F.col("o_totalprice")).alias("valor_total"),
        F.col("o_orderdate").alias("data_venda"), F.col("_metadata.file_path").alias("_source_file"))
    valid, bad, reports = (scratch_path(spark, f"validacao-{x}") for x in ("ok", "quarentena", "relatorio"))
    writers.finish(arrived.writeStream.option("checkpointLocation", scratch_path(spark, "validacao-ckpt"))
                   .foreachBatch(writers.validate_and_route("vendas", valid, bad, reports)))
    kept = spark.read.schema("id_venda bigint, lote string").parquet(bad).agg(F.count("*").alias("em_quarentena"))
    report = spark.read.parquet(reports).select("valido", "total_registros", "registros_invalidos")
    return report.withColumn("em_quarentena", kept.scalar())
