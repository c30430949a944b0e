"""Declared schemas of everything read from text or JSON."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# Column names of the hourly ridership files (fixed values of the file format).
HOURLY_FILE = T.StructType(
    [
        T.StructField("transit_timestamp", T.StringType()),
        T.StructField("bus_route", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("fare_class_category", T.StringType()),
        T.StructField("ridership", T.LongType()),
        T.StructField("transfers", T.LongType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])

TRIP_REQUEST = T.StructType(
    [
        T.StructField("departure", POINT),
        T.StructField("destination", POINT),
        T.StructField("timeToDestination", T.StringType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

INCENTIVE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

RIDE = T.StructType(
    [
        T.StructField("departureTime", T.StringType()),
        T.StructField("travelTime", T.LongType()),
        T.StructField("trafficDensity", T.StringType()),
    ]
)

INSIGHT = T.StructType(
    [
        T.StructField("travelTime", T.LongType()),
        T.StructField("trafficDensity", T.StringType()),
        T.StructField("costSavingsPerTrip", T.StringType()),
        T.StructField("nudgeMessage", T.StringType()),
        T.StructField("incentiveDetails", INCENTIVE),
        T.StructField("additionalRides", T.ArrayType(RIDE)),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

# Fixed values of the response contract.
INSIGHT_KEYS = ("travelTime", "trafficDensity", "costSavingsPerTrip", "nudgeMessage", "incentiveDetails")
INCENTIVE_KEYS = ("type", "description", "value")
DENSITY_CLASSES = ("Light", "Medium", "Heavy")
INCENTIVE_TYPES = ("eCredit", "partnerDiscount", "funReward")
