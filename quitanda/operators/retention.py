"""Retention plans. A plan is a table; moving or deleting objects is a separate step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    prefix: str
    archive_days: int
    delete_days: int
    enabled: bool = True


# Days before archiving, further days before deletion.
RULES = (
    Rule("raw-dados-brutos", "raw/", 90, 730),
    Rule("processed-dados-processados", "processed/", 180, 1095),
)
ARCHIVE_RULES = (Rule("archived", "archived/", 0, 730),)


def _by_prefix(rules, key: Column, pick) -> Column:
    out = F.lit(None)
    for r in reversed([r for r in rules if r.enabled]):
        out = F.when(key.startswith(r.prefix), F.lit(pick(r))).otherwise(out)
    return out


def retention_plan(objects: DataFrame, as_of: Column, rules=RULES, key: str = "key",
                   modified: str = "modified") -> DataFrame:
    """Action per object: delete, archive (with its new key) or keep. The handful of rules
    becomes one expression, so the plan is a projection of the listing."""
    k = F.col(key)
    age = F.floor((as_of.cast("timestamp").cast("long") - F.col(modified).cast("timestamp").cast("long")) / 86400)
    prefix = _by_prefix(rules, k, lambda r: r.prefix)
    archive = _by_prefix(rules, k, lambda r: r.archive_days)
    delete = _by_prefix(rules, k, lambda r: r.archive_days + r.delete_days)
    planned = objects.withColumns({
        "regra": _by_prefix(rules, k, lambda r: r.name), "idade_dias": age.cast("int"),
        "_archive": archive, "_delete": delete, "_prefix": prefix,
    }).where("regra is not null")
    action = (F.when(F.col("idade_dias") >= F.col("_delete"), "deletar")
              .when(F.col("idade_dias") >= F.col("_archive"), "arquivar").otherwise("manter"))
    return planned.withColumns({
        "acao": action,
        "dias_para_arquivar": F.col("_archive") - F.col("idade_dias"),
        "dias_para_deletar": F.col("_delete") - F.col("idade_dias"),
    }).withColumn(
        "nova_chave", F.when(F.col("acao") == "arquivar",
                             F.concat(F.lit("archived/"), F.substring(k, F.length("_prefix") + 1, F.length(k)))),
    ).drop("_archive", "_delete", "_prefix")


def retention_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("regra", "acao").agg(
        F.count("*").alias("objetos"), F.sum("bytes").cast("bigint").alias("bytes"))


def due_soon(plan: DataFrame, days: int = 7) -> DataFrame:
    """Objects that reach a limit within ``days``."""
    a, d = F.col("dias_para_arquivar"), F.col("dias_para_deletar")
    kind = F.when((a > 0) & (a <= days), "arquivar_em_breve").when((d > 0) & (d <= days), "deletar_em_breve")
    return plan.withColumn("pendente", kind).where("pendente is not null")


def archive_plan(objects: DataFrame, as_of: Column, days: int = 90, prefix: str = "raw/",
                 key: str = "key", modified: str = "modified") -> DataFrame:
    """Objects of one prefix older than ``days`` and where each would go."""
    old = F.col(modified).cast("timestamp") < as_of.cast("timestamp") - F.make_dt_interval(F.lit(days))
    return objects.where(F.col(key).startswith(prefix) & old).withColumn(
        "nova_chave", F.regexp_replace(key, "^" + prefix, "archived/"))


def archive_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("arquivos"),
                    (F.coalesce(F.sum("bytes"), F.lit(0)) / F.lit(1048576.0)).alias("total_mb"))


def expire_rows(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows still inside the retention period."""
    kind = dict(df.dtypes)[ts]
    return df.where(F.col(ts) >= F.date_sub(as_of, days).cast(kind))


