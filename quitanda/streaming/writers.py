"""Streaming sinks. Every write is keyed by the micro-batch id, so a retried batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quitanda.functions.dates import hour_label
from quitanda.operators.validation import SPECS, validate_files, with_findings
from quitanda.sources.versions import DayVersions


def finish(writer) -> StreamingQuery:
    """Process everything that has arrived, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_raw_events(events: DataFrame, path: str, checkpoint: str, rows_per_file: int = 0,
                     rows_per_task: int = 1_000_000, every: str | None = None):
    """JSON lines by event type and hour of event time; give ``every`` for a timed trigger.

    A micro-batch is shuffled by type and hour, so small groups give one file. Each group is cut
    into as many parts as the batch has ``rows_per_task``: a group holding a third of a large
    batch is written by that many tasks.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        parts = batch.withColumns({
            "tipo": F.coalesce("event_type", F.lit("DESCONHECIDO")),
            "hora": hour_label(F.col("timestamp").cast("timestamp")),
        })
        parts.persist()
        cuts = parts.count() // rows_per_task + 1
        # A numbered shuffle is not coalesced: creating files, not bytes, is what takes time.
        tasks = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Events without an id are dealt by their whole content, not into one task.
        content = F.xxhash64("_id", F.to_json(F.struct(*batch.columns)))
        shuffled = parts.repartition(tasks, "tipo", "hora", F.pmod(content, F.lit(cuts)))
        replace_batch(shuffled.write.option("maxRecordsPerFile", rows_per_file).partitionBy("tipo", "hora").format("json"),
                      batch_folder(batch.sparkSession, batch_id), path)
        parts.unpersist()

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(processingTime=every).start() if every else finish(writer)


def write_snapshot(metric: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Latest state of a metric as Parquet, replaced by each micro-batch."""
    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return finish(metric.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save))


def write_days(metric: DataFrame, path: str, checkpoint: str, keys: list[str], day: str) -> StreamingQuery:
    """A windowed metric with a watermark as a table by day, ``DayVersions``.

    In update mode a micro-batch gives the windows that changed and the state lets go of those the
    watermark has passed. Only the days of the changed windows are written anew, as a new version.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        load = batch_folder(batch.sparkSession, batch_id).removeprefix("lote=")
        DayVersions(batch.sparkSession, path).upsert(batch.withColumn("dia", F.to_date(day)), keys, load)
        batch.unpersist()

    return finish(metric.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save))


def write_append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode rows as Parquet with the file sink's exactly-once log."""
    return finish(rows.writeStream.outputMode("append").format("parquet").option("path", path)
                  .option("checkpointLocation", checkpoint))


def batch_folder(spark: SparkSession, batch_id: int) -> str:
    """Folder of a micro-batch: the id of its query, which lives in the checkpoint, and its number.

    A retry finds the same folder; a query with a new checkpoint starts folders of its own.
    """
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "lote"
    return f"lote={query}-{batch_id}"


def replace_batch(writer: DataFrameWriter, folder: str, path: str) -> None:
    """Write into the micro-batch's own folder; a retry of the batch replaces just that folder."""
    writer.mode("overwrite").option("partitionOverwriteMode", "static").save(f"{path}/{folder}")


def validate_and_route(dataset: str, valid: str, quarantine: str, reports: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: verdict per arrived file, whole files to ``valid`` or ``quarantine``."""
    spec = SPECS[dataset]

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        folder = batch_folder(batch.sparkSession, batch_id)
        replace_batch(validate_files(batch, spec).write.format("parquet"), folder, reports)
        # Read back: a written table has a known size, so Spark can decide on a broadcast.
        verdicts = batch.sparkSession.read.parquet(f"{reports}/{folder}")
        routed = with_findings(batch, spec).join(verdicts.select("_source_file", "valido"), "_source_file")
        good = routed.where("valido").drop("erros", "avisos", "valido")
        replace_batch(good.write.format("parquet"), folder, valid)
        replace_batch(routed.where("NOT valido").write.format("parquet"), folder, quarantine)
        batch.unpersist()

    return handle
