"""Messages that cannot be processed: retry, then set aside, then re-drive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quitanda.schemas import SALE_MESSAGE, SALE_MESSAGE_REQUIRED
from quitanda.streaming.writers import batch_folder, replace_batch

MAX_ATTEMPTS = 3


def message_errors(message: Column, required) -> Column:
    """Error codes of a decoded message; text that is no JSON object misses every field."""
    return F.filter(F.array(*[F.when(message[f].isNull(), f"ausente:{f}") for f in required]),
                    lambda e: e.isNotNull())


def route_messages(messages: DataFrame, ddl: str = SALE_MESSAGE, required=SALE_MESSAGE_REQUIRED,
                   max_attempts: int = MAX_ATTEMPTS, value: str = "value", attempts: str = "tentativas") -> DataFrame:
    """Decode and route: ``ok``, ``repetir`` (attempts left) or ``dlq``."""
    decoded = messages.withColumn("mensagem", F.from_json(F.col(value).cast("string"), ddl))
    checked = decoded.withColumn("erros", message_errors(F.col("mensagem"), required))
    tried = F.coalesce(F.col(attempts), F.lit(0)) + 1
    route = (F.when(F.size("erros") == 0, "ok")
             .when(tried >= max_attempts, "dlq").otherwise("repetir"))
    return checked.withColumns({attempts: tried, "rota": route})


def route_dead_letters(ok: str, retry: str, dlq: str, **how) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler writing each route to its own folder."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = route_messages(batch, **how).persist()
        folder = batch_folder(batch.sparkSession, batch_id)
        replace_batch(routed.where("rota = 'ok'").select("mensagem.*").write.format("parquet"), folder, ok)
        left = routed.select(F.col(how.get("value", "value")), how.get("attempts", "tentativas"), "erros", "rota")
        for route, path in (("repetir", retry), ("dlq", dlq)):
            replace_batch(left.where(F.col("rota") == route).drop("rota").write.format("parquet"), folder, path)
        routed.unpersist()

    return handle


def redrive(dead: DataFrame, attempts: str = "tentativas") -> DataFrame:
    """Dead letters back to messages with a fresh attempt count."""
    return dead.drop("erros", "lote").withColumn(attempts, F.lit(0))
