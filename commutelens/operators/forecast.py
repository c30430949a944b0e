"""Many-series quantile forecasts without a loaded model.

The contract is: history and a horizon in, a median with an 80 % band out. Samples for a step are the
series' own past values at the same seasonal phase (hour of day, day of week) or its own past changes over
the same distance. Both are plain aggregations; a model of the user's own plugs in through
``forecast_with_model``. The numbers are not those of any pretrained model.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commutelens.functions.numeric import arithmetic_hash, downward
from commutelens.operators.series import by_slot
from commutelens.params import FallbackParams

HOURLY_PERIOD = 24
DAILY_PERIOD = 7
MODEL_SCHEMA = "series_key string, step bigint, q10 double, q50 double, q90 double"


def _band(values: str | Column) -> Column:
    return F.percentile(values, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))


def _unpack(band: str) -> list[Column]:
    return [F.round(F.col(band)[i], 6).alias(name) for i, name in enumerate(("q10", "q50", "q90"))]


def seasonal_profile(series: DataFrame, period: int) -> DataFrame:
    """Quantiles per (series, phase) plus the series' last slot; a group holds one value per season."""
    phases = series.groupBy("series_key", F.pmod("slot", F.lit(period)).alias("phase")).agg(
        _band(F.col("y").cast("double")).alias("band"),
        F.count(F.lit(1)).alias("n"),
        F.max("slot").alias("phase_end"),
    )
    return phases.select(
        "series_key", "phase", "n", *_unpack("band"),
        F.max("phase_end").over(W.partitionBy("series_key")).alias("last_slot"),
    )


def _with_past(series: DataFrame, period: int, last: int) -> DataFrame:
    """Each row with the quantiles of its phase over the rows up to the one ``last`` places away. The window's state is a
    count per value that grows with every row, so no row is copied for the versions that see it."""
    so_far = W.partitionBy("series_key", "phase").orderBy("slot").rowsBetween(W.unboundedPreceding, last)
    phased = series.withColumn("phase", F.pmod("slot", F.lit(period)))
    return phased.withColumns({"band": _band(F.col("y").cast("double")).over(so_far), "n": F.count("y").over(so_far)})


def profile_versions(series: DataFrame, period: int) -> DataFrame:
    """Quantiles per (series, phase) as they were known over time: each version holds from slot ``since``, the start of the
    season after the one that it last learned from, until the next one's."""
    seen = _with_past(series, period, W.currentRow)
    since = (F.floor(F.col("slot") / period) + 1) * period
    return seen.select("series_key", "phase", since.alias("since"), "n", *_unpack("band"))


def unroll(profile: DataFrame, horizon: int, period: int) -> DataFrame:
    """Profile to one row per step 1..horizon. Each phase lists its own steps, so no join is needed."""
    first = F.pmod(F.col("phase") - F.col("last_slot") - 1, F.lit(period)) + 1
    steps = F.sequence(first, F.lit(horizon).cast("bigint"), F.lit(period).cast("bigint"))
    return (
        profile.withColumn("first_step", first)
        .filter(F.col("first_step") <= horizon)
        .withColumn("step", F.explode(steps))
        .select(
            "series_key", "step", (F.col("last_slot") + F.col("step")).alias("slot"),
            "n", "q10", "q50", "q90", downward(F.col("q50")).alias("prediction"),
        )
    )


def seasonal_forecast(series: DataFrame, horizon: int, period: int) -> DataFrame:
    return unroll(seasonal_profile(series, period), horizon, period)


def drift_forecast(series: DataFrame, horizon: int) -> DataFrame:
    """Last value plus the quantiles of past changes over the same number of steps (gap-free series)."""
    changes = F.array(
        *[
            F.struct(F.lit(h).cast("bigint").alias("step"), (F.lead("y", h).over(by_slot()) - F.col("y")).alias("change"))
            for h in range(1, horizon + 1)
        ]
    )
    whole = W.partitionBy("series_key")
    spread = series.select(
        "series_key",
        F.max_by("y", "slot").over(whole).alias("last_y"),
        F.max("slot").over(whole).alias("last_slot"),
        changes.alias("changes"),
    ).select("series_key", "last_y", "last_slot", F.inline("changes"))
    bands = spread.groupBy("series_key", "step", "last_y", "last_slot").agg(
        _band(F.col("change").cast("double")).alias("band")
    )
    moved = [
        F.round(F.col("last_y") + F.col("band")[i], 6).alias(name) for i, name in enumerate(("q10", "q50", "q90"))
    ]
    return bands.select("series_key", "step", (F.col("last_slot") + F.col("step")).alias("slot"), *moved).withColumn(
        "prediction", downward(F.col("q50"))
    )


def forecast_with_model(
    series: DataFrame, horizon: int, model: Callable[[pd.Series, int], pd.DataFrame]
) -> DataFrame:
    """Run a user's own model per series: ordered values and horizon in; step, q10, q50, q90 out.

    Input groups are aggregated series, one row per slot, so a group stays small whatever the raw volume.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("slot")
        out = model(ordered["y"].reset_index(drop=True), horizon)
        out.insert(0, "series_key", str(pdf["series_key"].iloc[0]))
        return out[["series_key", "step", "q10", "q50", "q90"]]

    return series.groupBy("series_key").applyInPandas(run, MODEL_SCHEMA)


def cards(profile: DataFrame) -> DataFrame:
    """One row per series: its last slot and its bands by phase, a map of at most ``period`` entries."""
    entry = F.struct(F.col("phase"), F.struct("q10", "q50", "q90"))
    return profile.groupBy("series_key").agg(
        F.first("last_slot").alias("last_slot"), F.map_from_entries(F.collect_list(entry)).alias("bands")
    )


def answer(requests: DataFrame, profile: DataFrame, period: int) -> DataFrame:
    """Integer answer per (series, horizon) request: zero at or below horizon 0, else the floored median.

    The horizon is mapped to its seasonal phase, so any horizon is answered from the same profile. Bands come
    as one row per series, so requests are shuffled once, by series.
    """
    phase = F.pmod(F.col("last_slot") + F.col("horizon"), F.lit(period))
    median = F.try_element_at("bands", phase)["q50"]
    found = requests.join(cards(profile), "series_key", "left")
    return found.withColumn(
        "prediction",
        F.when(F.col("horizon") <= 0, F.lit(0).cast("bigint")).otherwise(downward(median)),
    ).drop("bands", "last_slot")


def valid_horizon(text: Column) -> Column:
    """Route text to a whole number of steps; anything but a non-negative integer is null."""
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return number.cast("bigint")


def with_fallback(
    requests: DataFrame, series: DataFrame, period: int, fallback: FallbackParams, key_number: str
) -> DataFrame:
    """Answers that never fail: phase median, else series median, else the median of all series at the phase asked
    for, else a base level that varies with the key.

    A series without history has no last slot, so its steps count from the last slot of all series. ``source`` names
    the tier; a null horizon is invalid and gets no answer. ``key_number`` is an integer column that feeds the
    deterministic variation.
    """
    answered = answer(requests, seasonal_profile(series, period), period)
    overall = series.groupBy("series_key").agg(
        F.round(F.percentile(F.col("y").cast("double"), F.lit(0.5)), 6).alias("series_median")
    )
    base = (
        F.lit(fallback.base - fallback.variation)
        + arithmetic_hash(F.col(key_number), 2 * fallback.variation)
    ).cast("bigint")
    horizon = F.col("horizon")
    pooled = pooled_profile(series, period).select(
        F.col("phase").alias("_phase"), F.col("pooled_median").alias("_pooled")
    )
    end = series.agg(F.max("slot").alias("end")).scalar()
    placed = answered.join(overall, "series_key", "left").withColumn("_end", end)
    at = F.pmod(F.col("_end") + horizon, F.lit(period)) == F.col("_phase")
    return placed.join(pooled, at, "left").select(
        *requests.columns,
        F.when(horizon <= 0, F.lit(0).cast("bigint"))
        .when(horizon.isNotNull(), F.coalesce("prediction", downward(F.col("series_median")), downward(F.col("_pooled")), base))
        .alias("prediction"),
        F.when(horizon.isNull(), F.lit("invalid"))
        .when(horizon <= 0, F.lit("none"))
        .when(F.col("prediction").isNotNull(), F.lit("phase"))
        .when(F.col("series_median").isNotNull(), F.lit("series"))
        .when(F.col("_pooled").isNotNull(), F.lit("pooled"))
        .otherwise(F.lit("base"))
        .alias("source"),
    )


def pooled_profile(series: DataFrame, period: int, bins: int = 1024) -> DataFrame:
    """Median per phase over all series together, for series that have no history of their own.

    Values are counted, the counts are summed in ranges of equal width between the least and greatest value of a
    phase, and only the ranges that hold the middle ranks are looked at value by value. So no task gathers all
    values of a phase.
    """
    counted = series.groupBy(F.pmod("slot", F.lit(period)).alias("phase"), F.col("y").cast("double").alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ends = counted.groupBy(F.col("phase").alias("p")).agg(
        F.min("y").alias("low"), F.max("y").alias("high"), F.sum("n").alias("total")
    )
    width = F.greatest((F.col("high") - F.col("low")) / bins, F.lit(1e-300))
    ranged = counted.join(ends, F.col("phase") == F.col("p")).withColumn("bin", F.floor((F.col("y") - F.col("low")) / width))
    sizes = ranged.groupBy("phase", "bin", "total").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(W.partitionBy("phase").orderBy("bin")) - F.col("size")
    # Ranks, from zero, of the two values that the median lies between.
    lower, upper = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    wanted = (
        sizes.withColumn("before", before)
        .filter((F.col("before") <= upper) & (F.col("before") + F.col("size") > lower))
        .select(F.col("phase").alias("w_phase"), F.col("bin").alias("w_bin"), "before")
    )
    inside = ranged.join(wanted, (F.col("phase") == F.col("w_phase")) & (F.col("bin") == F.col("w_bin"))).withColumn(
        "until", F.col("before") + F.sum("n").over(W.partitionBy("phase", "bin").orderBy("y"))
    )

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("until") > rank, F.col("y")))

    return inside.groupBy("phase", F.col("total").alias("n_samples")).agg(
        F.round((at(lower) + at(upper)) / 2, 6).alias("pooled_median")
    ).select("phase", "pooled_median", "n_samples")


def backtest(series: DataFrame, cutoffs: Column, horizon: int, period: int) -> DataFrame:
    """Rolling-origin forecasts next to what happened.

    ``cutoffs`` is an array column of first unseen slots. History rows are copied once per later cutoff
    (a few) and the seasonal quantiles are grouped by (series, cutoff, phase).
    """
    cut = series.withColumn("cutoff", F.explode(cutoffs))
    train = cut.filter(F.col("slot") < F.col("cutoff")).groupBy(
        "series_key", "cutoff", F.pmod("slot", F.lit(period)).alias("phase")
    ).agg(_band(F.col("y").cast("double")).alias("band"))
    test = cut.filter((F.col("slot") >= F.col("cutoff")) & (F.col("slot") < F.col("cutoff") + horizon)).select(
        "series_key", "cutoff", F.pmod("slot", F.lit(period)).alias("phase"),
        (F.col("slot") - F.col("cutoff") + 1).alias("step"), F.col("y").cast("double").alias("actual"),
    )
    return test.join(train, ["series_key", "cutoff", "phase"]).select(
        "series_key", "cutoff", "step", "actual", *_unpack("band")
    )


def rolling_backtest(series: DataFrame, period: int) -> DataFrame:
    """Forecasts from the start of every season, over one season, next to what happened; a season's first slot is step 1.
    Rows without any earlier value at their phase have no forecast and are left out."""
    past = _with_past(series, period, -1).filter(F.col("band").isNotNull())
    return past.select(
        "series_key",
        (F.col("slot") - F.col("phase")).alias("cutoff"),
        (F.col("phase") + 1).alias("step"),
        F.col("y").cast("double").alias("actual"),
        *_unpack("band"),
    )


def error_by_step(results: DataFrame) -> DataFrame:
    """Error of the median and coverage of the band for each step."""
    error = F.col("actual") - F.col("q50")
    # corr() fails on constant columns under ANSI rules; there is no trend to compare then.
    spread = F.stddev_pop("actual") * F.stddev_pop("q50")
    correlation = F.try_divide(F.covar_pop("actual", "q50"), spread)
    return results.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(error * error), 6).alias("mse"),
        F.round(F.avg(F.when(F.col("actual") != 0, F.abs(error) / F.abs(F.col("actual")))), 6).alias("mape"),
        F.round(F.avg(F.when(F.col("actual").between(F.col("q10"), F.col("q90")), 1.0).otherwise(0.0)), 6).alias(
            "coverage_80"
        ),
        F.round(correlation, 6).alias("trend_corr"),
    )
