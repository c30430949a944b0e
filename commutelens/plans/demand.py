"""Ridership history to forecasts, and the daily regression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.functions import clock
from commutelens.operators import forecast, regression, series
from commutelens.params import DAILY_FALLBACK, HOURLY_FALLBACK, FallbackParams
from commutelens.sources import sinks


def hourly_forecast(rides: DataFrame, key: str, horizon: int = 24) -> DataFrame:
    """All series and all steps of the hourly forecast in one job."""
    return forecast.seasonal_forecast(series.hourly_series(rides, key), horizon, forecast.HOURLY_PERIOD)


def forecast_method(
    history: DataFrame, horizon: int, method: str = "seasonal", period: int = forecast.HOURLY_PERIOD, model=None
) -> DataFrame:
    """One entry point: ``seasonal``, ``drift`` (on a gap-free copy of the series) or a user's ``model``."""
    if method == "seasonal":
        return forecast.seasonal_forecast(history, horizon, period)
    if method == "drift":
        filled = series.forward_fill(series.fill_gaps(history)).select("series_key", "slot", F.col("y_filled").alias("y"))
        return forecast.drift_forecast(filled, horizon)
    if method == "model":
        return forecast.forecast_with_model(history, horizon, model)
    raise ValueError(f"unknown method: {method}")


@dataclass(frozen=True)
class Service:
    """One kind of forecast request: its seasonal period, stand-in level and the names in its envelopes."""

    model_type: str
    period: int
    fallback: FallbackParams
    horizon_field: str
    requested_field: str


HOURLY_SERVICE = Service("hourly", forecast.HOURLY_PERIOD, HOURLY_FALLBACK, "hours_future", "hours_requested")
DAILY_SERVICE = Service("daily", forecast.DAILY_PERIOD, DAILY_FALLBACK, "days_future", "days_requested")


def respond(requests: DataFrame, history: DataFrame, service: Service, key_number: str) -> DataFrame:
    """Every forecast request with its JSON envelope, or an error envelope where the horizon is no whole number.

    Requests carry ``series_key``, ``horizon_text`` and ``asked_at``; a series without history gets the
    stand-in level. All requests are answered in one job.
    """
    asked = requests.withColumn("horizon", forecast.valid_horizon(F.col("horizon_text")))
    answered = forecast.with_fallback(asked, history, service.period, service.fallback, key_number)
    good = sinks.envelope(service.horizon_field, service.model_type, F.col("asked_at"))
    bad = sinks.error_envelope(
        service.requested_field,
        service.model_type,
        F.lit("horizon is no whole number"),
        F.col("horizon_text"),
        F.col("asked_at"),
    )
    failed = F.col("horizon").isNull()
    return answered.withColumn("failed", failed).withColumn("envelope", F.when(failed, bad).otherwise(good))


def mode_table(mode_days: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Daily rows: each mode's percentage of its baseline (``<mode>_pct``) and its total (``<mode>_total``)."""
    marked = series.percent_of_baseline(mode_days)
    wide = marked.groupBy("slot").pivot("series_key", list(modes)).agg(
        F.first("pct", ignorenulls=True).alias("pct"), F.first("y", ignorenulls=True).alias("total")
    )
    return wide.withColumn("day", clock.day_of_slot(F.col("slot")))


def fit_daily(days: DataFrame, features: Sequence[str], target: str) -> LinearRegressionModel:
    clean = days.select("slot", *features, target).na.drop("any")
    return regression.fit_linear(clean.filter(regression.in_training(F.col("slot"))), features, target)


def holdout_daily(days: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Error of the fit on the days outside the training set."""
    kept_out = days.select("slot", *features, target).na.drop("any").filter(~regression.in_training(F.col("slot")))
    return regression.holdout_error(regression.score(fit_daily(days, features, target), kept_out, features), target)


def project_daily(days: DataFrame, features: Sequence[str], target: str, steps: int) -> DataFrame:
    """Fit on the training days, extend every feature by its mean daily change, score the coming days."""
    clean = days.select("slot", *features, target).na.drop("any")
    model = fit_daily(days, features, target)
    long = clean.unpivot(["slot"], list(features), "series_key", "y")
    future = series.extrapolate(long, steps)
    wide = future.groupBy("slot", "step").pivot("series_key", list(features)).agg(F.first("y"))
    scored = regression.score(model, wide, features)
    return scored.select(
        clock.day_of_slot(F.col("slot")).alias("day"), "step", F.round("prediction", 4).alias("prediction")
    )
