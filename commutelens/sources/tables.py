"""Frames of the transit model derived from the star-schema tables.

Each function reads one or two parquet tables and projects them; filters and columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commutelens.functions import clock, money
from commutelens.operators.joins import endpoints

MODES = ("click", "error", "purchase", "signup", "view")

# Declared schemas spare Spark the job that reads parquet footers before planning.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def ridership(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly ridership facts: one row per event."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("transit_timestamp"),
        F.concat(F.lit("R"), (F.col("user_id") % 20).cast("string")).alias("bus_route"),
        F.col("event_type").alias("payment_method"),
        F.concat(F.lit("F"), (F.col("event_id") % 8).cast("string")).alias("fare_class"),
        F.floor("value").cast("bigint").alias("ridership"),
        F.get_json_object("props", "$.k").cast("bigint").alias("transfers"),
        "user_id",
    )


def ridership_text(spark: SparkSession, folder: str) -> DataFrame:
    """The same facts as they stand in a text file; every 97th timestamp is malformed."""
    good = F.date_format("transit_timestamp", clock.AMPM_FORMAT)
    return ridership(spark, folder).select(
        "event_id",
        F.when(F.col("event_id") % 97 == 0, F.lit("not a time")).otherwise(good).alias("transit_timestamp"),
        "bus_route",
        "payment_method",
        F.col("fare_class").alias("fare_class_category"),
        "ridership",
        "transfers",
    )


def mode_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily totals per mode in integer hundredths, so sums do not depend on the order of addition."""
    days = table(spark, folder, "events").groupBy(
        F.col("event_type").alias("series_key"), clock.day_slot(F.col("ts")).alias("slot")
    )
    return days.agg(F.sum(money.cents(F.col("value"))).alias("hundredths")).select(
        "series_key", "slot", (F.col("hundredths") / 100.0).alias("y")
    )


def order_days(spark: SparkSession, folder: str) -> DataFrame:
    """One long daily series: order value per day."""
    days = table(spark, folder, "orders").groupBy(clock.day_slot(F.col("o_orderdate")).alias("slot"))
    return days.agg(F.sum(money.cents(F.col("o_totalprice"))).alias("hundredths")).select(
        F.lit("orders").alias("series_key"), "slot", (F.col("hundredths") / 100.0).alias("y")
    )


def stops(spark: SparkSession, folder: str) -> DataFrame:
    """Stop dimension with its region and whether the stop is in service."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("stop_id"),
        F.col("s_name").alias("stop"),
        F.col("s_nationkey").alias("region"),
        (F.lit(32.6) + ((key * 37) % 600) * F.lit(0.001)).alias("lat"),
        (F.lit(-80.2) + ((key * 91) % 400) * F.lit(0.001)).alias("lng"),
        (key % 6 == 0).alias("active"),
    )


def trip_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per click; a few name stops beyond the last known one."""
    return requests_of(table(spark, folder, "events"), table(spark, folder, "supplier"))


def requests_of(events: DataFrame, supplier: DataFrame) -> DataFrame:
    """Trip requests in a batch of events. The stop count is a scalar subquery, not a join."""
    clicks = events.filter(F.col("event_type") == "click")
    modulus = supplier.agg((F.count(F.lit(1)) + 3).alias("k")).scalar()
    e, minute = F.col("event_id"), (F.col("event_id") * 13) % 1440

    def stop_name(number):
        return F.concat(F.lit("Supplier#"), F.lpad(number.cast("string"), 9, "0"))

    return clicks.withColumn("_k", modulus).select(
        e.alias("request_id"),
        F.col("ts").alias("requested_at"),
        F.col("user_id").alias("rider_id"),
        F.concat(F.lit("R"), (F.col("user_id") % 20).cast("string")).alias("route"),
        stop_name((e * 7) % F.col("_k")).alias("dep_stop"),
        stop_name((e * 11 + 5) % F.col("_k")).alias("dst_stop"),
        F.concat_ws(
            ":",
            F.lpad(F.floor(minute / 60).cast("string"), 2, "0"),
            F.lpad((minute % 60).cast("string"), 2, "0"),
        ).alias("arrive_by"),
    )


def flow_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Traffic speed observed at a stop."""
    views = table(spark, folder, "events").filter(F.col("event_type") == "view")
    count = table(spark, folder, "supplier").agg(F.count(F.lit(1)).alias("k")).scalar()
    return views.withColumn("_k", count).select(
        F.col("event_id").alias("flow_id"),
        (F.col("user_id") % F.col("_k")).alias("stop_id"),
        F.col("ts").alias("observed_at"),
        (F.floor("value").cast("bigint") % 36 + 5).alias("mph"),
        F.lit(40).cast("bigint").alias("free_mph"),
    )


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Traffic incidents, valid for two hours; a few have no known end."""
    errors = table(spark, folder, "events").filter(F.col("event_type") == "error")
    e = F.col("event_id")
    return errors.select(
        e.alias("incident_id"),
        (F.lit(32.6) + (e % 600) * F.lit(0.001)).alias("lat"),
        (F.lit(-80.2) + ((e * 3) % 400) * F.lit(0.001)).alias("lng"),
        (F.get_json_object("props", "$.k").cast("bigint") % 12).alias("icon_category"),
        F.col("ts").alias("valid_from"),
        F.when(e % 211 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(2))).alias("valid_to"),
    )


def request_bodies(spark: SparkSession, folder: str, odd: bool = False) -> DataFrame:
    """Trip requests as JSON text; some lack a field, some are cut off. ``odd`` adds places that are no stop, empty
    places and unreadable times."""
    located = endpoints(trip_requests(spark, folder), stops(spark, folder))
    e = F.col("request_id")

    def point(side: str):
        lat, lng = F.col(f"{side}_lat").cast("string"), F.col(f"{side}_lng").cast("string")
        place = F.coalesce(F.concat(F.lit('{"lat":'), lat, F.lit(',"lng":'), lng, F.lit("}")), F.lit("null"))
        if odd:
            elsewhere, empty = (29, 31) if side == "dep" else (43, 47)
            place = F.when(e % elsewhere == 0, F.lit('{"lat":0.5,"lng":0.5}')).when(e % empty == 0, F.lit("{}")).otherwise(place)
        return place

    clock_text = F.when(e % 19 == 0, F.lit("")).otherwise(F.col("arrive_by"))
    if odd:
        clock_text = F.when(e % 37 == 0, F.lit("soon")).otherwise(clock_text)
    body = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(e % 17 != 0, F.concat(F.lit('"departure":'), point("dep"))),
            F.concat(F.lit('"destination":'), point("dst")),
            F.concat(F.lit('"timeToDestination":"'), clock_text, F.lit('"')),
        ),
        F.lit("}"),
    )
    cut = F.when(e % 23 == 0, F.substring(body, 1, 20)).otherwise(body)
    return located.select("request_id", "requested_at", "rider_id", "route", cut.alias("body"))


def response_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Insight responses as JSON text: keys missing, unknown enum values, and truncated text occur."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    density = F.element_at(
        F.array(*[F.lit(x) for x in ("Light", "Medium", "Heavy", "Severe")]), (e % 4 + 1).cast("int")
    )
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("eCredit", "partnerDiscount", "funReward", "cash")]), (e % 4 + 1).cast("int")
    )
    quoted = F.when(e % 10 == 4, F.lit("null")).otherwise(F.concat(F.lit('"'), density, F.lit('"')))
    incentive = F.concat(
        F.lit('{"type":"'),
        kind,
        F.lit('","description":"reward '),
        e.cast("string"),
        F.lit('"'),
        F.when(e % 7 != 0, F.concat(F.lit(',"value":"$'), (k % 3).cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.lit("}"),
    )
    body = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(e % 5 != 0, F.concat(F.lit('"travelTime":'), k.cast("string"))),
            F.when(e % 5 != 1, F.concat(F.lit('"trafficDensity":'), quoted)),
            F.when(e % 5 != 2, F.concat(F.lit('"costSavingsPerTrip":"'), (k % 7).cast("string"), F.lit('.50"'))),
            F.when(e % 5 != 3, F.concat(F.lit('"nudgeMessage":"trip '), e.cast("string"), F.lit('"'))),
            F.when(e % 6 != 5, F.concat(F.lit('"incentiveDetails":'), incentive)),
            F.lit('"additionalRides":[]'),
        ),
        F.lit("}"),
    )
    cut = F.when(e % 41 == 0, F.expr("left(_body, length(_body) - 3)")).otherwise(F.col("_body"))
    return table(spark, folder, "events").withColumn("_body", body).select(e.alias("response_id"), cut.alias("response"))


def incident_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Incident lists as nested JSON text, none to two incidents each, with fields nobody asked for."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")

    def incident(shift: int):
        return F.concat(
            F.lit('{"type":"Feature","id":"x","geometry":{"type":"Point","coordinates":['),
            ((e + shift) % 400).cast("string"),
            F.lit(".5,"),
            ((e + shift) % 600).cast("string"),
            F.lit('.25]},"properties":{"delay":7,"iconCategory":'),
            ((k + shift) % 12).cast("string"),
            F.lit("}}"),
        )

    listed = F.concat_ws(",", F.when(e % 3 >= 1, incident(0)), F.when(e % 3 >= 2, incident(1)))
    return table(spark, folder, "events").select(
        e.alias("feed_id"), F.concat(F.lit('{"incidents":['), listed, F.lit("]}")).alias("feed")
    )


def polled_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """The incidents as feed texts of one incident each, as a poll would bring them; some texts are cut off, some list an
    incident without a place, and some categories are written as text."""
    i, e = incidents(spark, folder), F.col("incident_id")
    kind = F.when(e % 13 == 0, F.concat(F.lit('"'), F.col("icon_category").cast("string"), F.lit('"'))).otherwise(F.col("icon_category").cast("string"))
    item = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['),
        F.concat_ws(",", F.col("lng").cast("string"), F.col("lat").cast("string")),
        F.lit(']},"properties":{"iconCategory":'),
        F.coalesce(kind, F.lit("null")),
        F.lit(',"delay":"unknown"}}'),
    )
    no_place = F.lit('{"type":"Feature","properties":{"events":[1,"x"]}}')
    feed = F.concat(F.lit('{"incidents":['), F.concat_ws(",", item, F.when(e % 5 == 0, no_place)), F.lit("]}"))
    cut = F.when(e % 41 == 0, F.substring(feed, 1, 30)).otherwise(feed)
    return i.select("incident_id", "valid_from", "valid_to", cut.alias("feed"))


def prediction_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction answers in every accepted shape, and in shapes without a number."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k")
    shape = e % 6
    payload = (
        F.when(shape == 0, k)
        .when(shape == 1, F.concat(F.lit('{"prediction":'), k, F.lit(',"model_type":"hourly"}')))
        .when(shape == 2, F.concat(F.lit("["), k, F.lit(",1]")))
        .when(shape == 3, F.lit('{"error":"no model"}'))
        .when(shape == 4, F.lit("[]"))
        .otherwise(F.lit('{"prediction":"soon"}'))
    )
    return table(spark, folder, "events").select(e.alias("payload_id"), payload.alias("payload"))


def horizon_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Forecast requests as route text: whole numbers, negative numbers and junk."""
    e = F.col("event_id")
    horizon = F.when(e % 13 == 0, F.lit("soon")).when(e % 17 == 0, F.lit("-3")).otherwise((e % 60).cast("string"))
    return table(spark, folder, "events").select(
        e.alias("request_id"), F.col("event_type").alias("series_key"), horizon.alias("horizon_text"), F.col("ts").alias("asked_at")
    )


def registrations(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_custkey")
    email = F.concat(F.lit("rider"), c.cast("string"), F.when(c % 9 == 0, F.lit(".example.com")).otherwise(F.lit("@example.com")))
    secret = F.concat(F.lit("pw"), (c * 31 % 1000).cast("string"))
    return table(spark, folder, "customer").select(
        c.alias("record_id"),
        F.when(c % 13 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        email.alias("email"),
        secret.alias("password"),
        F.when(c % 11 == 0, F.concat(secret, F.lit("x"))).otherwise(secret).alias("confirm_password"),
    )


def riders(spark: SparkSession, folder: str) -> DataFrame:
    """Commute length and working days of each rider."""
    c = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        c.alias("rider_id"),
        (F.lit(5) + c % 31).cast("bigint").alias("miles_per_day"),
        (F.lit(200) + c % 61).cast("bigint").alias("days_per_year"),
    )


def vehicle_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of buses and cars with the riders on board and the miles driven."""
    bus = F.col("l_linestatus") == "O"
    load = F.col("l_quantity").cast("bigint")
    return table(spark, folder, "lineitem").select(
        F.when(bus, F.lit("bus")).otherwise(F.lit("car")).alias("mode"),
        F.when(bus, load).otherwise(load % 4 + 1).alias("passengers"),
        F.col("l_linenumber").cast("bigint").alias("miles"),
    )


def cost_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Cost comparisons as people write them: a percentage somewhere in the text."""
    return table(spark, folder, "part").select(
        F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("criterion"),
        F.concat((F.col("p_size") + 50).cast("string"), F.lit("%")).alias("car_text"),
        F.concat(F.lit("lower ("), F.col("p_size").cast("string"), F.lit("%), "), F.col("p_name")).alias("bus_text"),
    )
