"""Sinks. All of them write from the executors; nothing passes through the driver.

A job that runs again under the same ``run`` replaces what it wrote and leaves all other runs alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_forecasts(forecasts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Forecast table, ordered by series inside files so that readers skip row groups by key."""
    ordered = forecasts.repartitionByRange("series_key", "step").sortWithinPartitions("series_key", "step")
    ordered.write.mode(mode).parquet(path)


def write_run(rows: DataFrame, path: str, run: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Rows of one run of a job below a table's path, in folders by run and then by ``by``."""
    name = quote(run, safe="")
    writer = rows.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(f"{path.rstrip('/')}/run={name}")


def write_partitioned_forecasts(forecasts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per series, for a modest number of series."""
    forecasts.write.mode(mode).partitionBy("series_key").parquet(path)


def envelope(horizon_field: str, model_type: str, at: Column) -> Column:
    """Prediction envelope as JSON text."""
    return F.to_json(
        F.struct(
            F.col("prediction").alias("prediction"),
            F.col("horizon").alias(horizon_field),
            F.lit(model_type).alias("model_type"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        )
    )


def error_envelope(requested_field: str, model_type: str, details: Column, requested: Column, at: Column) -> Column:
    """Error envelope as JSON text with the requested horizon echoed."""
    return F.to_json(
        F.struct(
            F.lit(f"{model_type} forecast failed").alias("error"),
            details.alias("details"),
            requested.alias(requested_field),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        )
    )


def write_json_lines(rows: DataFrame, text: str, path: str, mode: str = "overwrite") -> None:
    rows.select(F.col(text).alias("value")).write.mode(mode).text(path)


def write_errors(rejected: DataFrame, path: str, run: str) -> None:
    """Error records of a run; those of other runs stay."""
    write_run(rejected.select("error", "details", "payload"), path, run, "json")


def write_insights(insights: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Nested insight rows as parquet or JSON."""
    insights.write.mode(mode).format(fmt).save(path)
