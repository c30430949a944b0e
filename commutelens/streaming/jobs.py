"""Structured Streaming jobs: new history files, hourly totals, trip requests, resend suppression.

Every job has a checkpoint in the shared folder, so a restarted driver or a lost executor resumes from the
last committed batch. Timestamps become zoned ones because watermarks need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from commutelens.functions import clock

LATENESS = "1 hour"


def history_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """New history files as they arrive. All that are there make one micro-batch, so that a watermark never passes rows
    of files not read yet; with ``files_per_batch`` the files should come in order of event time."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def hourly_totals(rides: DataFrame, key: str, ts: str, y: str, lateness: str = LATENESS) -> DataFrame:
    """Hourly sums per key. An hour is emitted once the watermark has passed its end; later rows are dropped."""
    timed = rides.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", lateness)
    return (
        timed.groupBy(F.window("_event_time", "1 hour"), F.col(key).alias("series_key"))
        .agg(F.sum(y).alias("y"))
        .select("series_key", F.col("window.start").cast("timestamp_ntz").alias("hour"), "y")
    )


def sums_by_batch(rides: DataFrame, key: str, ts: str, y: str, path: str, checkpoint: str) -> StreamingQuery:
    """Hourly sums of each micro-batch, in a folder of its own that a repeated batch overwrites, over everything available
    now. No state is kept and no row is too late: a row that comes after its hour was answered is a correction in the
    batch that brings it. ``hours_so_far`` merges the batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.filter(F.col(ts).isNotNull()).groupBy(F.col(key).alias("series_key"), clock.hour_floor(F.col(ts)).alias("hour"))
        parts = sums.agg(F.sum(y).alias("y"), F.max(ts).alias("latest"))
        parts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return rides.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hours_so_far(spark: SparkSession, path: str, lateness: str = LATENESS) -> DataFrame:
    """(series_key, hour, y, closed, corrected) from what the stream wrote, and from nothing else.

    ``closed`` tells hours that ended at least ``lateness`` before the latest row so far; ``corrected`` those that a later
    batch added to after an earlier one had closed them. Keys may be null.
    """
    schema = "series_key string, hour timestamp_ntz, y bigint, latest timestamp_ntz, batch_id bigint"
    parts = spark.read.schema(schema).parquet(path)
    delay = F.expr(f"INTERVAL {lateness}")
    reached = parts.groupBy("batch_id").agg((F.date_trunc("millisecond", F.max("latest")) - delay).cast("timestamp_ntz").alias("reached"))
    # One row per batch: what the stream had passed when the batch began, and by now.
    earlier = W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1)
    passed = reached.select("batch_id", F.max("reached").over(earlier).alias("passed"))
    ends = F.col("hour") + F.expr("INTERVAL 1 hour")
    late = F.coalesce(ends <= F.col("passed"), F.lit(False))
    whole = parts.join(passed, "batch_id").groupBy("series_key", "hour").agg(F.sum("y").alias("y"), F.max(late).alias("corrected"))
    now = reached.agg(F.max("reached")).scalar()
    return whole.select("series_key", "hour", "y", F.coalesce(ends <= now, F.lit(False)).alias("closed"), "corrected")


def without_resends(requests: DataFrame, request_id: str, ts: str, lateness: str = LATENESS) -> DataFrame:
    """First copy of each request; a copy that arrives within the watermark delay is dropped."""
    timed = requests.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", lateness)
    return timed.dropDuplicatesWithinWatermark([request_id]).drop("_event_time")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append of a stream to parquet, over everything available now."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def per_batch(
    stream: DataFrame,
    transform: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Batch plan over each micro-batch: results to one folder, rejects to another.

    Every batch overwrites its own folder, so a batch that is run again after a failure leaves one copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = transform(batch)
        accepted.write.mode("overwrite").parquet(f"{accepted_path}/batch_id={batch_id}")
        rejected.write.mode("overwrite").json(f"{rejected_path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
