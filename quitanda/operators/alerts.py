"""Alerts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Severity and title per alert kind.
ALERTS = (
    ("PIPELINE_FAILURE", "CRITICO", "Pipeline FALHOU"),
    ("DATA_QUALITY_FAILURE", "ALTO", "Falha na qualidade dos dados"),
    ("PIPELINE_SUCCESS", "INFO", "Pipeline concluído com sucesso"),
    ("SCHEMA_VALIDATION_ERROR", "ALTO", "Erro de validação de schema"),
    ("DATA_FRESHNESS_ALERT", "MEDIO", "Dados desatualizados detectados"),
    ("ROW_COUNT_DROP", "ALTO", "Queda no volume de dados detectada"),
)


def freshness_alert(df: DataFrame, ts: str, as_of: Column, hours: int = 25) -> DataFrame:
    """Hours since the newest row, flagged above the limit; an empty table is stale."""
    last = F.max(F.col(ts).cast("timestamp"))
    age = (as_of.cast("long") - last.cast("long")) / 3600.0
    return df.agg(last.alias("ultima_atualizacao"), age.alias("horas"),
                  F.coalesce(age > hours, F.lit(True)).alias("alerta"))


def row_drop_alert(daily: DataFrame, ratio: float = 0.8) -> DataFrame:
    from quitanda.operators.windows import row_drops

    return row_drops(daily, ratio=ratio).where("alerta")


def pass_rate_alert(rates: DataFrame, minimum: float = 0.95) -> DataFrame:
    return rates.where(F.col("pass_rate") < minimum)


def traffic_light(c: Column, green: float, amber: float) -> Column:
    """Higher is better: above ``green`` is green, above ``amber`` amber, else red."""
    return F.when(c > green, "verde").when(c > amber, "amarelo").otherwise("vermelho")


def alert_rules(spark) -> DataFrame:
    return spark.createDataFrame(ALERTS, "tipo string, nivel string, assunto string")


def with_severity(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Severity and title by alert kind; the rules are the six fixed rows above."""
    return alerts.join(F.broadcast(rules), "tipo", "left").na.fill({"nivel": "INFO"})
