"""Money as integer cents; text only at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commutelens.functions.numeric import round_half_up
from commutelens.params import TRIP, TripParams


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def dollars_text(cents_col: Column) -> Column:
    """Cents as ``d.cc``; null stays null."""
    text = F.concat(
        F.floor(cents_col / 100).cast("string"), F.lit("."), F.lpad((cents_col % 100).cast("string"), 2, "0")
    )
    return F.when(cents_col.isNotNull(), text)


def trip_savings_cents(miles: Column, params: TripParams = TRIP) -> Column:
    """What a rider saves against driving the same miles, never below zero."""
    per_mile = params.gas_cents_per_gallon / params.miles_per_gallon
    driving = round_half_up(miles * F.lit(per_mile)) + F.lit(params.parking_cents)
    saved = driving - F.lit(params.fare_cents)
    return F.when(saved < 0, F.lit(0).cast("bigint")).otherwise(saved)


def incentive_usd(density: Column, params: TripParams = TRIP) -> Column:
    """Reward by traffic class, whatever its letter case; none for an unknown class."""
    klass = F.lower(density)
    return (
        F.when(klass == "light", F.lit(params.incentive_light_usd))
        .when(klass == "medium", F.lit(params.incentive_medium_usd))
        .when(klass == "heavy", F.lit(params.incentive_heavy_usd))
        .cast("bigint")
    )
