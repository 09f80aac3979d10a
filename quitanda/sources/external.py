"""Option sets for systems whose connector jar the caller provides."""

from __future__ import annotations


def jdbc_incremental(url: str, table: str, cursor: str, last: str | None, *, key: str,
                     bounds: tuple[int, int], partitions: int, fetch: int = 10_000) -> dict[str, str]:
    """Options for a parallel ``spark.read.format("jdbc")`` pull of rows newer than ``last``."""
    if last is None:
        source = table
    else:
        quoted = last.replace("'", "''")
        source = f"(SELECT * FROM {table} WHERE {cursor} > '{quoted}') AS novos"
    return {
        "url": url, "dbtable": source, "partitionColumn": key,
        "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
        "numPartitions": str(partitions), "fetchsize": str(fetch),
    }


def jdbc_full(url: str, table: str, fetch: int = 10_000) -> dict[str, str]:
    return {"url": url, "dbtable": table, "fetchsize": str(fetch)}


def kafka_read(servers: str, topic: str, per_trigger: int) -> dict[str, str]:
    """Offsets live in the query checkpoint; Spark assigns its own consumer group."""
    return {
        "kafka.bootstrap.servers": servers, "subscribe": topic,
        "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger),
    }


def kafka_write(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}
