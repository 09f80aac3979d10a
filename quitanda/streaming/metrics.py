"""Live event metrics. Each takes a streaming or a batch frame with the event columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quitanda.functions.events import purchase_value

TYPE, TIME = "event_type", "timestamp"


def with_event_time(events: DataFrame, ts: str = TIME, watermark: str | None = None) -> DataFrame:
    """Event time as TIMESTAMP (watermarks refuse TIMESTAMP_NTZ), optionally watermarked."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, watermark) if watermark else out


def stream_counts(events: DataFrame) -> DataFrame:
    kind = F.coalesce(F.col(TYPE), F.lit("DESCONHECIDO")).alias(TYPE)
    return events.groupBy(kind).agg(F.count("*").alias("eventos"))


def _windowed(events: DataFrame, window: Column, *keys: str) -> DataFrame:
    counted = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("eventos"))
    return counted.select(F.col("w.start").alias("inicio"), F.col("w.end").alias("fim"), *keys, "eventos")


def stream_minute(events: DataFrame) -> DataFrame:
    """Events per tumbling minute of event time."""
    return _windowed(events, F.window(TIME, "1 minute"))


def stream_sliding(events: DataFrame, length: str = "1 minute", step: str = "10 seconds") -> DataFrame:
    return _windowed(events, F.window(TIME, length, step), TYPE)


def stream_revenue(events: DataFrame, value: Column | None = None) -> DataFrame:
    """Purchase revenue per event day; a purchase without value counts as zero."""
    amount = purchase_value(F.col(TYPE), F.col("valor_total").cast("decimal(15,2)")) if value is None else value
    by = events.groupBy(F.window(TIME, "1 day").alias("w")).agg(F.sum(amount).cast("decimal(18,2)").alias("receita"))
    return by.select(F.to_date("w.start").alias("dia"), "receita")


def stream_products(events: DataFrame, product: Column) -> DataFrame:
    """Views per product; rank the snapshot with :func:`heavy_hitters` or in complete mode."""
    return events.where(product.isNotNull()).groupBy(product.alias("produto")).agg(F.count("*").alias("qtd"))


def stream_top(events: DataFrame, product: Column, n: int = 5) -> DataFrame:
    """The n most seen products (complete mode)."""
    return stream_products(events, product).orderBy(F.desc("qtd"), F.asc("produto")).limit(n)


def stream_sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    """Events per user session; a session ends after ``gap`` without events."""
    return _windowed(events, F.session_window(TIME, gap), key)


def session_counts(events: DataFrame, key: str = "session_id") -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("eventos"))


def dedup_events(events: DataFrame, key: str = "_id") -> DataFrame:
    """Each id once, remembered as long as the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def drop_alert(minutes: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Minutes whose count fell below ``ratio`` of the minute before.

    Windowed per day plus the last minute of the day before, so no partition grows with history.
    """
    minute = F.expr("INTERVAL 1 MINUTE")
    days = F.array_distinct(F.array(F.to_date("inicio"), F.to_date(F.col("inicio") + minute)))
    spread = minutes.select("inicio", "eventos", F.explode(days).alias("_day"))
    w = Window.partitionBy("_day").orderBy("inicio")
    before = F.when(F.lag("inicio").over(w) == F.col("inicio") - minute, F.lag("eventos").over(w))
    return (spread.withColumn("minuto_anterior", before)
            .where((F.to_date("inicio") == F.col("_day")) & (F.col("eventos") < F.col("minuto_anterior") * F.lit(ratio)))
            .drop("_day"))


def dashboard(events: DataFrame, product: Column, as_of: Column, n: int = 5) -> DataFrame:
    """One row per metric and item: totals, counts by type, top products, last minute."""
    item = lambda df, metric, name, value: df.select(
        F.lit(metric).alias("metrica"), name.alias("item"), value.cast("decimal(18,2)").alias("valor"))
    counts = stream_counts(events)
    minute = F.col(TIME) > as_of.cast("timestamp") - F.expr("INTERVAL 1 MINUTE")
    none = F.lit(None).cast("string")
    totals = events.agg(F.count("*").alias("n"), F.coalesce(
        F.sum(purchase_value(F.col(TYPE), F.col("valor_total").cast("decimal(15,2)"))), F.lit(0)).alias("v"),
        F.count_if(minute).alias("m"))
    return (item(totals, "total_eventos", none, F.col("n"))
            .unionByName(item(totals, "receita_acumulada", none, F.col("v")))
            .unionByName(item(totals, "eventos_ultimo_minuto", none, F.col("m")))
            .unionByName(item(counts, "eventos_por_tipo", F.col(TYPE), F.col("eventos")))
            .unionByName(item(stream_top(events, product, n), "top_produtos", F.col("produto").cast("string"), F.col("qtd"))))
