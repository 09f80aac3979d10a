"""Streaming readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quitanda import schemas


def arriving_files(spark: SparkSession, path: str, schema, fmt: str, suffix: str,
                   files_per_trigger: int | None = None, **options) -> DataFrame:
    """Each new file once; the query checkpoint remembers what was seen."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", suffix)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**options).load(path)


def events_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return arriving_files(spark, path, schemas.struct(schemas.EVENT), "json", "*.jsonl",
                          files_per_trigger, recursiveFileLookup=True)


def kafka_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load()


def decode_events(messages: DataFrame, value: str = "value", ddl: str = schemas.EVENT) -> DataFrame:
    """JSON message values to columns; ``_raw`` keeps the text for dead letters."""
    text = F.col(value).cast("string")
    return messages.select(F.from_json(text, ddl).alias("e"), text.alias("_raw")).select("e.*", "_raw")


def keyed_messages(events: DataFrame, key: Column) -> DataFrame:
    """key/value frame for a topic partitioned by user."""
    return events.select(key.cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
