"""Session defaults. A cluster's own settings win: only what is unset is filled in."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# State on disk with changelogs, for streams whose state outgrows the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_utc(spark: SparkSession) -> SparkSession:
    """History timestamps are zone-free; pinning UTC keeps text parsing and formatting zone-free too."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(app: str, cores: int | str = 8, shuffle_partitions: int = 8, work: str | None = None) -> SparkSession:
    """Session for tests and the benchmark on one machine; ``work`` is the folder for what queries write."""
    builder = SparkSession.builder.config("spark.sql.warehouse.dir", work) if work else SparkSession.builder
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: the one a cluster names in ``spark.checkpoint.dir``, or else the
    session's warehouse."""
    return spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get("spark.sql.warehouse.dir")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, on shared storage; whoever runs the job removes it."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind once it is written; they stay otherwise until the driver
    collects garbage. Meant for frames that are executed once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes an intermediate that several branches of a plan read, and returns the written table.

    The branches then share one evaluation, lost executors cost no recomputation, and Spark knows the table's
    true size when it chooses between broadcast and shuffle. The caller names the folder and removes it.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
