"""Readers for ridership files, the stop list, trip requests and landed traffic tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commutelens.functions import clock
from commutelens.schemas import CORRUPT, HOURLY_FILE, TRIP_REQUEST

DATE_COLUMN = "Date"


def type_hourly(text_rows: DataFrame) -> DataFrame:
    """Parsed timestamps next to the text; a row is bad if its time or its rider count did not parse."""
    typed = text_rows.withColumn("ts", clock.parse_ampm(F.col("transit_timestamp")))
    broken = F.col("ts").isNull() | F.col("ridership").isNull()
    if CORRUPT in text_rows.columns:
        broken = broken | F.col(CORRUPT).isNotNull()
    return typed.withColumn("is_bad", broken)


def split_hourly(text_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed facts and the quarantined rows with the input echoed."""
    typed = type_hourly(text_rows)
    good = typed.filter(~F.col("is_bad")).select(
        F.col("ts").alias("transit_timestamp"),
        "bus_route",
        "payment_method",
        F.col("fare_class_category").alias("fare_class"),
        "ridership",
        "transfers",
    )
    payload = F.to_json(F.struct(*[c for c in text_rows.columns if c != CORRUPT]))
    bad = typed.filter("is_bad").select(
        F.lit("Unreadable ridership row").alias("error"),
        F.when(F.col("ts").isNull(), F.lit("transit_timestamp")).otherwise(F.lit("ridership")).alias("details"),
        (F.coalesce(F.col(CORRUPT), payload) if CORRUPT in text_rows.columns else payload).alias("payload"),
    )
    return good, bad


def layouts(spark: SparkSession, path: str, required: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the order of columns in their header: the line that names all required columns.

    What comes back is one entry per file, as in any listing of files.
    """
    names = F.transform(F.split(F.col("value"), ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    wanted = F.array(*[F.lit(c) for c in required])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), names.alias("names"))
    heads = lines.filter(F.size(F.array_except(wanted, F.col("names"))) == 0).groupBy("file").agg(F.min("names").alias("names"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in heads.orderBy("file").collect():
        found.setdefault(tuple(row["names"]), []).append(row["file"])
    if not found:
        raise ValueError(f"missing columns: {', '.join(required)}")
    return found


def read_by_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files whose headers name the schema's columns in any order, and perhaps others: each layout is read by its
    own header, so values never land in another column. Lines that do not parse are kept in the corrupt record."""
    kinds = {f.name: f.dataType for f in schema if f.name != CORRUPT}
    out = None
    for names, files in layouts(spark, path, list(kinds)).items():
        layout = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
        raw = (
            spark.read.schema(layout.add(CORRUPT, T.StringType()))
            .option("header", True)
            .option("enforceSchema", False)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(files)
            .select(*kinds, CORRUPT)
        )
        out = raw if out is None else out.unionByName(raw)
    return out


def read_hourly(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Hourly ridership CSV with a declared schema: (facts, quarantine). Odd route names are kept."""
    return split_hourly(read_by_header(spark, path, HOURLY_FILE))


def safe_name(name: str) -> str:
    """Column name without characters that need quoting."""
    return re.sub(r"[^0-9a-z]+", "_", name.lower().replace("%", "pct")).strip("_")


def read_daily(spark: SparkSession, path: str, measures: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Daily wide CSV: (the date and the named measures as doubles, quarantine). Other columns are never read, and an
    empty value is a gap; a date or a number that does not parse puts the line into quarantine."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (DATE_COLUMN, *measures)])
    raw = read_by_header(spark, path, schema)
    text = {safe_name(m): F.nullif(F.trim(F.col(f"`{m}`")), F.lit("")) for m in measures}
    typed = raw.select(
        clock.parse_day(F.col(DATE_COLUMN)).alias("date"),
        *[t.try_cast("double").alias(n) for n, t in text.items()],
        F.array_compact(
            F.array(
                F.when(clock.parse_day(F.col(DATE_COLUMN)).isNull(), F.lit("date")),
                *[F.when(t.isNotNull() & t.try_cast("double").isNull(), F.lit(n)) for n, t in text.items()],
            )
        ).alias("_broken"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in (DATE_COLUMN, *measures)])).alias("_payload"),
    )
    bad = typed.filter(F.size("_broken") > 0).select(
        F.lit("Unreadable daily row").alias("error"), F.array_join("_broken", ",").alias("details"), F.col("_payload").alias("payload")
    )
    return typed.filter(F.size("_broken") == 0).drop("_broken", "_payload"), bad


def daily_long(wide: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Wide days to a series frame, one row per (measure, day)."""
    return wide.unpivot(["date"], list(measures), "series_key", "y").select(
        "series_key", F.unix_date("date").cast("bigint").alias("slot"), "y"
    )


def read_stops(spark: SparkSession, path: str, active: Sequence[str] | None = None) -> DataFrame:
    """Stop dimension from CSV (stop, region, lat, lng) with a flag for stops in service."""
    raw = spark.read.schema("stop string, region string, lat double, lng double").option("header", True).csv(path)
    flag = F.lit(True) if active is None else F.col("stop").isin(list(active))
    return raw.withColumn("stop_id", F.col("stop")).withColumn("active", flag)


def active_stops(stops: DataFrame, listed: DataFrame) -> DataFrame:
    """Stops that appear in the list of stops in service."""
    return stops.join(listed, "stop", "left_semi")


def list_stops(stops: DataFrame) -> DataFrame:
    return stops.select("stop").distinct().orderBy("stop")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Trip requests, one JSON object per line, with what does not parse kept as text."""
    return spark.read.schema(TRIP_REQUEST).option("columnNameOfCorruptRecord", CORRUPT).json(path)


# Stops are known by name in landed files, as in the stop list.
FLOW_SCHEMA = "flow_id bigint, stop_id string, observed_at timestamp_ntz, mph bigint, free_mph bigint"
INCIDENT_SCHEMA = (
    "incident_id bigint, lat double, lng double, icon_category bigint, valid_from timestamp_ntz, valid_to timestamp_ntz"
)


def read_landed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", options: Mapping[str, str] | None = None) -> DataFrame:
    """Landed traffic observations or incidents, as parquet or JSON."""
    return spark.read.schema(schema).options(**(options or {})).format(fmt).load(path)
