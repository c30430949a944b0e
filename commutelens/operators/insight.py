"""Rules that turn a located trip with traffic into an insight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commutelens.functions import clock, geo, money, wording
from commutelens.params import TRIP, TripParams
from commutelens.schemas import DENSITY_CLASSES, INCENTIVE_TYPES


def with_distance(trips: DataFrame) -> DataFrame:
    return trips.withColumn(
        "miles", geo.great_circle_miles(F.col("dep_lat"), F.col("dep_lng"), F.col("dst_lat"), F.col("dst_lng"))
    )


def with_arrival(requests: DataFrame, params: TripParams = TRIP) -> DataFrame:
    arrival = clock.resolve_arrival(F.col("requested_at"), F.col("arrive_by"))
    return (
        requests.withColumn("arrival_at", arrival)
        .withColumn("hours_ahead", clock.hours_between(F.col("requested_at"), F.col("arrival_at")))
        .withColumn("long_horizon", F.col("hours_ahead") > params.long_horizon_hours)
    )


def density(flow_percent: Column, incidents: Column, params: TripParams = TRIP) -> Column:
    """Traffic class from current against free flow, one class worse with many incidents on the way."""
    rank = (
        F.when(flow_percent >= params.light_flow_percent, F.lit(1))
        .when(flow_percent >= params.medium_flow_percent, F.lit(2))
        .when(flow_percent.isNotNull(), F.lit(3))
    )
    worse = F.when(incidents >= params.incident_threshold, F.lit(1)).otherwise(F.lit(0))
    classes = F.array(*[F.lit(c) for c in DENSITY_CLASSES])
    return F.when(rank.isNotNull(), F.element_at(classes, F.least(rank + worse, F.lit(3))))


def with_traffic_result(trips: DataFrame, params: TripParams = TRIP) -> DataFrame:
    """Travel minutes, traffic class and savings. Without any flow observation time and class stay null."""

    def percent(side: str) -> Column:
        return F.floor(F.col(f"{side}_mph") * 100 / F.col(f"{side}_free_mph")).cast("bigint")

    slowest = F.least("dep_mph", "dst_mph")
    speed = F.when(
        slowest.isNotNull(), F.greatest(F.lit(params.min_mph), F.least(F.lit(params.max_mph), slowest))
    )
    minutes = F.ceil(F.round(F.col("miles") * 60 / speed, 6)).cast("bigint")
    return (
        trips.withColumn("flow_percent", F.least(percent("dep"), percent("dst")))
        .withColumn("travel_minutes", minutes)
        .withColumn("density", density(F.col("flow_percent"), F.col("incidents"), params))
        .withColumn("savings_cents", money.trip_savings_cents(F.col("miles"), params))
    )


def be_at_stop(now: Column, travel_minutes: Column, params: TripParams = TRIP) -> Column:
    return clock.plus_minutes(now, travel_minutes - F.lit(params.stop_buffer_minutes))


def typed_incentive(request_id: Column, density_class: Column, params: TripParams = TRIP) -> Column:
    """Kind of reward by request, worth more in heavier traffic; null without a traffic class."""
    kind = F.element_at(F.array(*[F.lit(t) for t in INCENTIVE_TYPES]), (F.pmod(request_id, F.lit(3)) + 1).cast("int"))
    credit = (
        F.when(density_class == "Light", F.lit(params.credit_light_cents))
        .when(density_class == "Medium", F.lit(params.credit_medium_cents))
        .when(density_class == "Heavy", F.lit(params.credit_heavy_cents))
        .cast("bigint")
    )
    value = F.concat(F.lit("$"), money.dollars_text(credit))
    what = (
        F.when(kind == "eCredit", F.lit(" credit on the next ride"))
        .when(kind == "partnerDiscount", F.lit(" off at a partner shop"))
        .otherwise(F.lit(" voucher for a treat"))
    )
    return F.when(
        credit.isNotNull(),
        F.struct(kind.alias("type"), F.concat(value, what).alias("description"), value.alias("value")),
    )


def with_message(trips: DataFrame) -> DataFrame:
    return trips.withColumn(
        "nudge",
        wording.nudge(F.col("travel_minutes"), F.col("density"), F.col("savings_cents"), F.col("predicted_riders")),
    )


def display(trips: DataFrame) -> DataFrame:
    """Texts of the result page: units, dollar sign, a stand-in for what is missing."""
    return trips.select(
        "request_id",
        wording.shown(F.col("travel_minutes"), suffix=" mins").alias("travel_time"),
        wording.shown(F.col("density")).alias("density"),
        wording.shown(money.dollars_text(F.col("savings_cents")), prefix="$").alias("savings"),
    )


def ride_list_text(rides: Column) -> Column:
    """Other rides as one line; the departure time is left out where unknown, an empty list gives null."""
    lines = F.transform(
        rides,
        lambda r: F.concat(
            F.coalesce(F.concat(r["departure_time"], F.lit(" ")), F.lit("")),
            r["travel_minutes"].cast("string"),
            F.lit(" mins "),
            r["density"],
        ),
    )
    return F.when(F.size(rides) > 0, F.array_join(lines, "; "))
