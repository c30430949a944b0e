"""Bus against car: emissions and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.functions import wording
from commutelens.params import BUS_COST_INDEX, EMISSION, EmissionParams


def mode_factors(spark, params: EmissionParams = EMISSION) -> DataFrame:
    """Two rows, bus and car: grams per mile, riders, grams per rider and mile."""
    rows = [("bus", params.bus.grams_per_mile, params.bus.passengers), ("car", params.car.grams_per_mile, params.car.passengers)]
    frame = spark.createDataFrame(rows, "mode string, grams_per_mile double, passengers double")
    return frame.withColumn("grams_per_passenger_mile", F.col("grams_per_mile") / F.col("passengers"))


def cost_factors(spark) -> DataFrame:
    """Ten rows: a bus rider's cost index per criterion, with the car at 100."""
    rows = [(name, 100, bus) for name, bus in BUS_COST_INDEX.items()]
    return spark.createDataFrame(rows, "criterion string, car_percent bigint, bus_percent bigint")


def observed_factors(runs: DataFrame, params: EmissionParams = EMISSION) -> DataFrame:
    """Grams per passenger mile of each mode, from vehicle runs with their real load."""
    grams_per_mile = F.when(F.col("mode") == "bus", F.lit(params.bus.grams_per_mile)).otherwise(
        F.lit(params.car.grams_per_mile)
    )
    standard = F.when(
        F.col("mode") == "bus", F.lit(params.bus.grams_per_mile / params.bus.passengers)
    ).otherwise(F.lit(params.car.grams_per_mile / params.car.passengers))
    totals = runs.groupBy("mode").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("miles").alias("vehicle_miles"),
        F.sum(F.col("miles") * F.col("passengers")).alias("passenger_miles"),
    )
    return totals.select(
        "mode",
        "runs",
        "vehicle_miles",
        "passenger_miles",
        F.round(F.col("vehicle_miles") * grams_per_mile / F.col("passenger_miles"), 6).alias("grams_per_passenger_mile"),
        F.round(standard, 6).alias("standard_grams_per_passenger_mile"),
    )


def commute_emissions(riders: DataFrame, params: EmissionParams = EMISSION) -> DataFrame:
    """Daily and yearly emissions of each rider by bus and by car, and what the bus saves.

    Everything is computed from grams per mile, riders per vehicle, miles and days.
    """
    bus = params.bus.grams_per_mile / params.bus.passengers
    car = params.car.grams_per_mile / params.car.passengers
    miles, days = F.col("miles_per_day"), F.col("days_per_year")
    return riders.select(
        *riders.columns,
        F.round(miles * F.lit(bus), 4).alias("bus_daily_grams"),
        F.round(miles * F.lit(car), 4).alias("car_daily_grams"),
        F.round(miles * days * F.lit(bus) / 1000, 4).alias("bus_annual_kg"),
        F.round(miles * days * F.lit(car) / 1000, 4).alias("car_annual_kg"),
        F.round(miles * F.lit(car - bus), 4).alias("daily_grams_saved"),
        F.round(miles * days * F.lit(car - bus) / 1000, 4).alias("annual_kg_saved"),
        F.round(F.when(miles > 0, F.lit(100.0 * (car - bus) / car)), 4).alias("percent_saved"),
    )


def cost_index_long(texts: DataFrame) -> DataFrame:
    """Percentages read out of text, one row per (criterion, mode), with the saving against the car."""
    numbers = texts.select(
        "criterion", wording.percent_in(F.col("car_text")).alias("car"), wording.percent_in(F.col("bus_text")).alias("bus")
    ).withColumn("saving_percent", F.round(F.try_divide((F.col("car") - F.col("bus")) * 100.0, F.col("car")), 6))
    return numbers.unpivot(["criterion", "saving_percent"], ["car", "bus"], "mode", "percent")


def trip_pounds_saved(miles, params: EmissionParams = EMISSION):
    """Pounds of CO2 one trip by bus saves."""
    return F.round(miles * F.lit(params.saved_grams_per_passenger_mile) / F.lit(params.grams_per_pound), 4)
