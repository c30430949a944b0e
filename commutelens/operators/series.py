"""Ridership series: aggregation, gap filling and the window operators over them.

A series frame has ``series_key``, an integer ``slot`` (hours or days since 1970) and ``y``. Raw rows are
summed per (key, slot) before anything else, with Spark's map-side partial aggregation, so a key that holds
a third of all raw rows reaches the shuffle as one row per slot and task. Every later window is partitioned
by key and therefore bounded by the number of slots in the history, never by the number of raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from commutelens.functions import clock


def by_slot() -> WindowSpec:
    return W.partitionBy("series_key").orderBy("slot")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail before planning when an input column is missing."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}; present: {', '.join(df.columns)}")
    return df


def find_target(df: DataFrame, needles: Sequence[str] = ("ridership", "total")) -> str | None:
    """First column whose lower-case name contains one of the needles; None when there is none."""
    return next((c for c in df.columns if any(n in c.lower() for n in needles)), None)


def discovered_daily(df: DataFrame, key: str, ts: str, needles: Sequence[str] = ("ridership", "total")) -> DataFrame:
    """Daily series of a table whose measure is known by a part of its name only. Where the key, the time or any such
    column is missing the series is empty, so that forecasts from it fall back instead of failing."""
    target = find_target(df.drop(key, ts), needles)
    if target is None or {key, ts} - set(df.columns):
        return df.sparkSession.createDataFrame([], "series_key string, slot bigint, y double")
    days = df.groupBy(F.col(key).cast("string").alias("series_key"), clock.day_slot(F.col(ts)).alias("slot"))
    return days.agg(F.sum(F.col(target).cast("double")).alias("y"))


def hourly_series(rides: DataFrame, key: str, ts: str = "transit_timestamp", y: str = "ridership") -> DataFrame:
    """One row per (key, hour) with the summed measure."""
    require_columns(rides, [key, ts, y])
    return rides.groupBy(F.col(key).alias("series_key"), clock.hour_slot(F.col(ts)).alias("slot")).agg(
        F.sum(y).alias("y")
    )


def daily_series(rides: DataFrame, key: str | Column, ts: str = "transit_timestamp", y: str = "ridership") -> DataFrame:
    """One row per (key, day) with the summed measure."""
    key_col = F.col(key) if isinstance(key, str) else key
    return rides.groupBy(key_col.alias("series_key"), clock.day_slot(F.col(ts)).alias("slot")).agg(
        F.sum(y).alias("y")
    )


def percent_of_baseline(series: DataFrame) -> DataFrame:
    """Each value as a percentage of its series' own mean."""
    baseline = F.avg("y").over(W.partitionBy("series_key"))
    return series.withColumn("pct", F.lit(100.0) * F.col("y") / baseline)


def widen(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per slot, one column per named key; the fixed key list spares Spark a discovery job."""
    return series.groupBy("slot").pivot("series_key", list(keys)).agg(F.first(value, ignorenulls=True))


def breakdown(rides: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums over every subset of the dimensions, with the grouping id that tells them apart.

    The raw rows are summed on the full key first; only that small result is expanded by the cube.
    """
    finest = rides.groupBy(*dims).agg(*[F.sum(m).alias(m) for m in measures])
    return finest.cube(*dims).agg(
        F.grouping_id().cast("bigint").alias("grouping_level"), *[F.sum(m).alias(m) for m in measures]
    )


def ratio_by(rides: DataFrame, key: str, part: str, whole: str, name: str) -> DataFrame:
    sums = rides.groupBy(key).agg(F.sum(part).alias(part), F.sum(whole).alias(whole))
    return sums.withColumn(name, F.round(F.try_divide(F.col(part), F.col(whole)), 6))


def mean_change(series: DataFrame, y: str = "y") -> DataFrame:
    """Mean first difference per series.

    Consecutive differences telescope, so the mean is (last - first) / (n - 1): one aggregation with partial
    sums, no window. Needs rows without nulls.
    """
    span = F.max_by(y, "slot") - F.min_by(y, "slot")
    return series.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(span.cast("double"), F.count(F.lit(1)) - F.lit(1)).alias("drift"),
        F.max("slot").alias("last_slot"),
        F.max_by(y, "slot").alias("last_y"),
    )


def last_known(series: DataFrame, y: str = "y") -> DataFrame:
    return series.groupBy("series_key").agg(F.max("slot").alias("slot"), F.max_by(y, "slot").alias("y"))


def coverage(keys: DataFrame, series: DataFrame) -> DataFrame:
    """Observed slots, span and holes of every key, including keys without any history."""
    seen = series.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n"), (F.max("slot") - F.min("slot") + 1).alias("span")
    )
    return keys.join(seen, "series_key", "left").select(
        "series_key",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n_slots"),
        F.coalesce("span", F.lit(0).cast("bigint")).alias("span_slots"),
        F.coalesce(F.col("span") - F.col("n"), F.lit(0).cast("bigint")).alias("missing_slots"),
        F.col("n").isNull().alias("needs_fallback"),
    )


def fill_gaps(series: DataFrame) -> DataFrame:
    """Every slot between a series' first and last; slots without data have a null ``y``.

    Each row generates the slots up to its successor, so the spine needs no join back to the data.
    """
    until = series.withColumn("until", F.coalesce(F.lead("slot").over(by_slot()) - 1, F.col("slot")))
    return until.withColumn("filled", F.explode(F.sequence("slot", "until"))).select(
        "series_key",
        F.col("filled").alias("slot"),
        F.when(F.col("filled") == F.col("slot"), F.col("y")).alias("y"),
    )


def forward_fill(series: DataFrame, y: str = "y", name: str = "y_filled") -> DataFrame:
    """Last non-null value at or before each slot."""
    upto = by_slot().rowsBetween(W.unboundedPreceding, W.currentRow)
    return series.withColumn(name, F.last(y, ignorenulls=True).over(upto))


def first_difference(series: DataFrame) -> DataFrame:
    """Change against the previous row of the series; null on its first row."""
    return series.withColumn("diff", F.col("y") - F.lag("y").over(by_slot()))


def future_slots(series: DataFrame, steps: int) -> DataFrame:
    """The next ``steps`` slots after each series' last one."""
    ends = series.groupBy("series_key").agg(F.max("slot").alias("last_slot"))
    return ends.select(
        "series_key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(steps).cast("bigint"))).alias("step"), "last_slot"
    ).select("series_key", "step", (F.col("last_slot") + F.col("step")).alias("slot"))


def extrapolate(series: DataFrame, steps: int, y: str = "y") -> DataFrame:
    """Last value plus k times the mean change, for the next ``steps`` slots (closed form, no loop)."""
    step = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(steps).cast("bigint")))
    return (
        mean_change(series, y)
        .select("series_key", "last_slot", "last_y", "drift", step.alias("step"))
        .select(
            "series_key",
            "step",
            (F.col("last_slot") + F.col("step")).alias("slot"),
            (F.col("last_y") + F.col("step") * F.coalesce("drift", F.lit(0.0))).alias("y"),
        )
    )


def stitch(chunks: DataFrame, key: str, seq: str, text: str, block: int = 256) -> DataFrame:
    """Ordered concatenation of text chunks per key.

    Chunks are joined in blocks of ``block`` sequence numbers first, so sorting never holds more than one
    block; the second step only strings the blocks together.
    """
    blocks = chunks.groupBy(F.col(key), F.floor(F.col(seq) / F.lit(block)).alias("block")).agg(
        F.expr(f"listagg({text}, '') WITHIN GROUP (ORDER BY {seq})").alias("part"),
        F.count(F.lit(1)).alias("n"),
    )
    return blocks.groupBy(key).agg(
        F.expr("listagg(part, '') WITHIN GROUP (ORDER BY block)").alias("text"), F.sum("n").alias("n_chunks")
    )
