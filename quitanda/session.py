"""Session settings, lake layout and the shared scratch folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. All of them can be changed on a running session.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose key is also the next grouping key must still be split when a key is hot.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Tasks that list folders; Spark's own 10,000 make one of each folder of a table by day.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # Sessions of a hot key are merged inside each input task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Large keyed stream state lives in RocksDB, not on the executor heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def pin(spark: SparkSession) -> SparkSession:
    for key, value in PINNED.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def conf(spark: SparkSession, **settings: str):
    """Settings for one action; ``__`` in a name stands for a dot."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ROWS_AT_ONCE = 16_000_000  # sales that are shuffled at a time; what a job needs of disk beside its tables grows with it


def parts_of(rows: int) -> int:
    """How many parts ``rows`` are worked in."""
    return max(1, -(-rows // ROWS_AT_ONCE))


def in_groups(counts: list[tuple]) -> list[list]:
    """The keys of (key, rows), in their order, in groups of up to ROWS_AT_ONCE rows; a key is not cut."""
    groups, held = [], 0
    for key, rows in counts:
        if not groups or held + rows > ROWS_AT_ONCE:
            groups.append([])
            held = 0
        groups[-1].append(key)
        held += rows
    return groups


_TIDY = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def tidy(spark: SparkSession):
    """For writes: the shuffle files of a write go when it ends, not when the driver collects its garbage."""
    return conf(spark, **_TIDY)


def many_files(spark: SparkSession):
    """``tidy``, for writes into many folders: creating files, not bytes, takes the time, so small shuffles
    keep their tasks."""
    return conf(spark, spark__sql__adaptive__coalescePartitions__minPartitionSize="16KB", **_TIDY)


def small_methods(spark: SparkSession):
    """For rows of many computed columns: the JVM never compiles generated methods of over 8,000 bytes,
    so stages that have such run operator by operator, whose code Spark splits."""
    return conf(spark, spark__sql__codegen__hugeMethodLimit="8000")


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PINNED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class LakePaths:
    """Zone roots on any file system Spark can reach."""

    root: str

    def raw(self, source: str) -> str:
        return f"{self.root}/raw/{source}"

    def processed(self, dataset: str) -> str:
        return f"{self.root}/processed/{dataset}"

    def archived(self, dataset: str) -> str:
        return f"{self.root}/archived/{dataset}"

    def quarantine(self, source: str) -> str:
        return f"{self.root}/raw/quarentena/{source}"

    def warehouse(self, schema: str, table: str) -> str:
        return f"{self.root}/{schema}/{table}"


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` or, without one, the warehouse every executor shares."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared.rstrip('/')}/quitanda/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Remove the scratch folders this process made; frames read from them are gone after that."""
    for path in _scratch:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    dropped = len(_scratch)
    _scratch.clear()
    return dropped


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and fixes the result of anything that depends on task layout, so a lost
    executor can only make Spark read the same files again.
    """
    path = scratch_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
