"""Registered queries: each reads whole tables of a folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commutelens import params
from commutelens.functions import clock, jsons, money, numeric, wording
from commutelens.operators import forecast, impact, insight, joins, quality, regression, rides, series
from commutelens.plans import demand, trip_insight
from commutelens.schemas import CORRUPT, TRIP_REQUEST
from commutelens.session import new_folder as run_folder
from commutelens.session import stage
from commutelens.sources import readers, sinks, tables
from commutelens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HORIZON = 24
DAILY_HORIZON = 14
PROJECTED_DAYS = 5
FEATURES = ("click_pct", "error_pct", "signup_pct", "view_pct")
TARGET = "purchase_total"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def joined(array) -> object:
    return F.array_join(array, ",")


# --- stops, requests, sources -------------------------------------------------------------------------


@query
def stops_dim(spark, folder):
    return tables.stops(spark, folder)


@query
def active_stops_semi(spark, folder):
    stops = tables.stops(spark, folder)
    listed = stops.filter("active").select("stop")
    return readers.active_stops(stops.drop("active"), listed)


@query
def stops_distinct(spark, folder):
    return readers.list_stops(tables.stops(spark, folder))


@query
def parse_ampm(spark, folder):
    text = tables.ridership_text(spark, folder)
    return text.select("event_id", clock.parse_ampm(F.col("transit_timestamp")).alias("ts"))


@query
def ridership_parsed(spark, folder):
    good, _ = readers.split_hourly(tables.ridership_text(spark, folder))
    return good


@query
def ridership_quarantine(spark, folder):
    _, bad = readers.split_hourly(tables.ridership_text(spark, folder).drop("event_id"))
    return bad


@query
def parse_dates(spark, folder):
    key = F.col("o_orderkey")
    text = F.when(key % 53 == 0, F.lit("13/45/1999")).when(key % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
    text = F.coalesce(text, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return tables.table(spark, folder, "orders").select(key.alias("order_id"), clock.parse_day(text).alias("day"))


@query
def requests_from_json(spark, folder):
    r = jsons.with_parsed(tables.request_bodies(spark, folder), "body", TRIP_REQUEST, "request")
    return r.select(
        "request_id",
        F.col("request.departure.lat").alias("dep_lat"),
        F.col("request.departure.lng").alias("dep_lng"),
        F.col("request.destination.lat").alias("dst_lat"),
        F.col("request.destination.lng").alias("dst_lng"),
        F.col("request.timeToDestination").alias("arrive_by"),
        F.col(f"request.{CORRUPT}").isNull().alias("is_json"),
    )


@query
def json_requests_split(spark, folder):
    bodies, stops = tables.request_bodies(spark, folder, odd=True), tables.stops(spark, folder)
    judged = trip_insight.judge_bodies(bodies, stops)
    return judged.select(
        "request_id",
        F.when(F.col("error").isNull(), F.lit("accepted")).otherwise(F.lit("rejected")).alias("outcome"),
        F.concat_ws(": ", "error", "details").alias("reason"),
    )


@query
def request_rejects(spark, folder):
    _, errors = trip_insight.locate_bodies(tables.request_bodies(spark, folder), tables.stops(spark, folder))
    return errors


# --- projections and validation -----------------------------------------------------------------------


@query
def trunc_vs_floor(spark, folder):
    shifted = F.col("value") - 50
    return tables.table(spark, folder, "events").select(
        "event_id", numeric.toward_zero(shifted).alias("truncated"), numeric.downward(shifted).alias("floored")
    )


@query
def round_js(spark, folder):
    halves = F.floor(F.col("value")) - 50 + (F.col("event_id") % 4) * 0.5
    return tables.table(spark, folder, "events").select("event_id", numeric.round_half_up(halves).alias("rounded"))


@query
def incidents_flat(spark, folder):
    items = trip_insight.feed_items(tables.incident_feeds(spark, folder))
    return items.select("feed_id", "position", "type", "geometry_type", "lng", "lat", "icon_category")


@query
def incidents_polled(spark, folder):
    """Feed texts to incidents on the way, by category. Texts are parsed and trips located once, and written."""
    hazards = stage(trip_insight.feed_incidents(tables.polled_feeds(spark, folder)), run_folder(spark, "hazards"))
    return trip_insight.incident_categories(stage(matched_trips(spark, folder), run_folder(spark, "trips")), hazards)


@query
def valid_clock_text(spark, folder):
    e = F.col("event_id")
    good = F.date_format("ts", "h:mm a")
    text = (
        F.when(e % 5 == 0, F.date_format("ts", "HH:mm"))
        .when(e % 5 == 1, F.lower(F.date_format("ts", "hh:mma")))
        .when(e % 5 == 2, F.concat(good, F.lit(" ")))
        .otherwise(good)
    )
    return tables.table(spark, folder, "events").select("event_id", wording.is_clock12(text).alias("is_valid"))


@query
def enum_violations(spark, folder):
    parsed = quality.parse_responses(tables.response_texts(spark, folder)).filter(F.col("error").isNull())
    rules = quality.enum_rules(F.col("insight.trafficDensity"), F.col("insight.incentiveDetails.type"))
    checked = quality.apply_rules(parsed, rules)
    return checked.filter(~F.col("accepted")).select(
        "response_id",
        joined("reasons").alias("reasons"),
        F.col("insight.trafficDensity").alias("density"),
        F.col("insight.incentiveDetails.type").alias("incentive_type"),
    )


@query
def missing_keys(spark, folder):
    gaps = quality.response_gaps(tables.response_texts(spark, folder))
    return gaps.select(
        "response_id", joined("missing").alias("missing"), joined("missing_incentive").alias("missing_incentive")
    )


@query
def missing_key_counts(spark, folder):
    gaps = quality.response_gaps(tables.response_texts(spark, folder))
    names = F.concat(
        F.coalesce("missing", F.array()),
        F.transform(F.coalesce("missing_incentive", F.array()), lambda k: F.concat(F.lit("incentiveDetails."), k)),
    )
    return gaps.select(F.explode(names).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query
def parse_or_reject(spark, folder):
    return quality.parse_responses(tables.response_texts(spark, folder)).select(
        "response_id",
        F.when(F.col("error").isNull(), F.col("insight.travelTime")).alias("travel_minutes"),
        F.when(F.col("error").isNull(), F.col("insight.trafficDensity")).alias("density"),
        "error",
    )


@query
def coalesced_trip(spark, folder):
    parsed = quality.parse_responses(tables.response_texts(spark, folder)).filter(F.col("error").isNull())
    return parsed.select(
        "response_id",
        F.coalesce("insight.travelTime", F.lit(0).cast("bigint")).alias("travel_minutes"),
        F.coalesce("insight.trafficDensity", F.lit("unknown")).alias("density"),
        F.coalesce("insight.costSavingsPerTrip", F.lit("0.00")).alias("savings"),
        F.size(F.coalesce("insight.additionalRides", F.array())).cast("bigint").alias("n_rides"),
    )


@query
def unwrap_prediction(spark, folder):
    return tables.prediction_payloads(spark, folder).select(
        "payload_id", jsons.unwrap_number(F.col("payload")).alias("prediction")
    )


@query
def rule_report(spark, folder):
    checked = quality.apply_rules(tables.registrations(spark, folder), quality.registration_rules())
    return checked.select("record_id", "accepted", joined("reasons").alias("reasons"))


@query
def stitch_chunks(spark, folder):
    chunks = tables.table(spark, folder, "conversations")
    return series.stitch(chunks, "conv_id", "turn", "text")


# --- series ------------------------------------------------------------------------------------------


def at_hour(df):
    return df.withColumn("ts", clock.hour_of_slot(F.col("slot"))).drop("slot")


def at_day(df):
    return df.withColumn("day", clock.day_of_slot(F.col("slot"))).drop("slot")


@query
def hourly_ridership(spark, folder):
    return at_hour(series.hourly_series(tables.ridership(spark, folder), "payment_method"))


@query
def daily_ridership(spark, folder):
    return at_day(series.daily_series(tables.ridership(spark, folder), "bus_route"))


@query
def daily_mode_wide(spark, folder):
    wide = series.widen(series.percent_of_baseline(tables.mode_days(spark, folder)), tables.MODES, "pct")
    return at_day(wide.select("slot", *[F.round(m, 6).alias(f"{m}_pct") for m in tables.MODES]))


@query
def drop_null_days(spark, folder):
    wide = series.widen(tables.mode_days(spark, folder), tables.MODES, "y")
    holed = wide.withColumn("view", F.when(F.col("slot") % 7 != 0, F.col("view")))
    return at_day(holed.na.drop("any"))


@query
def ridership_cube(spark, folder):
    dims = ["bus_route", "payment_method", "fare_class"]
    return series.breakdown(tables.ridership(spark, folder), dims, ["ridership", "transfers"])


@query
def transfer_ratio(spark, folder):
    return series.ratio_by(tables.ridership(spark, folder), "bus_route", "transfers", "ridership", "transfer_ratio")


@query
def mean_daily_change(spark, folder):
    pct = series.percent_of_baseline(tables.mode_days(spark, folder))
    return series.mean_change(pct, "pct").select("series_key", "n", F.round("drift", 6).alias("drift"))


@query
def series_coverage(spark, folder):
    keys = tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("series_key"))
    return series.coverage(keys, series.hourly_series(tables.ridership(spark, folder), "user_id"))


@query
def hourly_diff(spark, folder):
    return at_hour(series.first_difference(series.hourly_series(tables.ridership(spark, folder), "payment_method")))


def route_payment_hours(spark, folder):
    rides_ = tables.ridership(spark, folder).withColumn("cell", F.concat_ws("/", "bus_route", "payment_method"))
    return series.fill_gaps(series.hourly_series(rides_, "cell"))


@query
def hour_gapfill(spark, folder):
    return at_hour(route_payment_hours(spark, folder))


@query
def ffill_hours(spark, folder):
    return at_hour(series.forward_fill(route_payment_hours(spark, folder)))


@query
def last_known(spark, folder):
    pct = series.percent_of_baseline(tables.mode_days(spark, folder))
    return at_day(series.last_known(pct, "pct").withColumn("y", F.round("y", 6)))


@query
def future_dates(spark, folder):
    return at_day(series.future_slots(tables.order_days(spark, folder), DAILY_HORIZON))


@query
def future_features(spark, folder):
    pct = series.percent_of_baseline(tables.mode_days(spark, folder))
    return at_day(series.extrapolate(pct, PROJECTED_DAYS, "pct").withColumn("y", F.round("y", 6)))


@query
def days_newest_first(spark, folder):
    return at_day(tables.order_days(spark, folder).orderBy(F.col("slot").desc()).drop("series_key"))


# --- forecasts ----------------------------------------------------------------------------------------


def hours_by(spark, folder, key):
    return series.hourly_series(tables.ridership(spark, folder), key)


@query
def forecast_hourly(spark, folder):
    return at_hour(demand.hourly_forecast(tables.ridership(spark, folder), "payment_method", HORIZON))


@query
def forecast_daily(spark, folder):
    days = tables.order_days(spark, folder)
    return at_day(forecast.seasonal_forecast(days, DAILY_HORIZON, forecast.DAILY_PERIOD))


@query
def forecast_drift(spark, folder):
    return at_hour(demand.forecast_method(hours_by(spark, folder, "payment_method"), HORIZON, "drift"))


@query
def forecast_interval(spark, folder):
    bands = demand.hourly_forecast(tables.ridership(spark, folder), "bus_route", HORIZON)
    return at_hour(bands.select("series_key", "slot", "q10", "q50", "q90", F.round(F.col("q90") - F.col("q10"), 6).alias("width")))


def answered_requests(spark, folder):
    asked = tables.horizon_requests(spark, folder).withColumn(
        "horizon", forecast.valid_horizon(F.col("horizon_text"))
    )
    profile = forecast.seasonal_profile(hours_by(spark, folder, "payment_method"), forecast.HOURLY_PERIOD)
    return forecast.answer(asked, profile, forecast.HOURLY_PERIOD)


@query
def forecast_request(spark, folder):
    return answered_requests(spark, folder).select("request_id", "series_key", "horizon", "prediction")


@query
def forecast_envelope(spark, folder):
    good = sinks.envelope("hours_future", "hourly", F.col("asked_at"))
    bad = sinks.error_envelope(
        "hours_requested", "hourly", F.lit("horizon is no whole number"), F.col("horizon_text"), F.col("asked_at")
    )
    return answered_requests(spark, folder).select(
        "request_id", F.when(F.col("horizon").isNull(), bad).otherwise(good).alias("envelope")
    )


def rider_requests(spark, folder):
    c = F.col("c_custkey")
    return tables.table(spark, folder, "customer").select(c.alias("series_key"), (c % 25).alias("horizon"))


@query
def forecast_with_fallback(spark, folder):
    return forecast.with_fallback(
        rider_requests(spark, folder),
        hours_by(spark, folder, "user_id"),
        forecast.HOURLY_PERIOD,
        params.HOURLY_FALLBACK,
        "series_key",
    )


@query
def forecast_discovered(spark, folder):
    """Daily forecasts from a table whose measure is found by its name."""
    rides = tables.ridership(spark, folder).withColumnRenamed("ridership", "Total_Riders").drop("transfers")
    return day_fallback(spark, folder, series.discovered_daily(rides, "user_id", "transit_timestamp"))


@query
def forecast_without_columns(spark, folder):
    """The same requests where the table has no such measure: every answer comes from the base level."""
    rides = tables.ridership(spark, folder).withColumnRenamed("ridership", "boardings").drop("transfers")
    return day_fallback(spark, folder, series.discovered_daily(rides, "user_id", "transit_timestamp"))


def day_fallback(spark, folder, days):
    asked = rider_requests(spark, folder).withColumn("series_number", F.col("series_key")).withColumn("series_key", F.col("series_key").cast("string"))
    return forecast.with_fallback(asked, days, forecast.DAILY_PERIOD, params.DAILY_FALLBACK, "series_number").drop("series_number")


@query
def forecast_fallback_daily(spark, folder):
    return forecast.with_fallback(
        rider_requests(spark, folder),
        series.daily_series(tables.ridership(spark, folder), "user_id"),
        forecast.DAILY_PERIOD,
        params.DAILY_FALLBACK,
        "series_key",
    )


@query
def forecast_pooled(spark, folder):
    return forecast.pooled_profile(hours_by(spark, folder, "user_id"), forecast.HOURLY_PERIOD)


@query
def backtest_error(spark, folder):
    hourly = hours_by(spark, folder, "payment_method")
    return forecast.error_by_step(forecast.rolling_backtest(hourly, forecast.HOURLY_PERIOD))


def rider_service(spark, folder, history, service):
    c = F.col("c_custkey")
    requests = tables.table(spark, folder, "customer").select(
        c.alias("request_id"),
        c.alias("series_key"),
        F.when(c % 13 == 0, F.lit("1.5")).otherwise((c % 40).cast("string")).alias("horizon_text"),
        F.lit("2024-01-31 08:00:00").cast("timestamp_ntz").alias("asked_at"),
    )
    return demand.respond(requests, history, service, "series_key").select("request_id", "failed", "envelope")


@query
def service_hourly(spark, folder):
    return rider_service(spark, folder, hours_by(spark, folder, "user_id"), demand.HOURLY_SERVICE)


@query
def service_daily(spark, folder):
    days = series.daily_series(tables.ridership(spark, folder), "user_id")
    return rider_service(spark, folder, days, demand.DAILY_SERVICE)


# --- regression ---------------------------------------------------------------------------------------


@query
def train_test_split(spark, folder):
    days = tables.order_days(spark, folder)
    return at_day(days.select("slot", regression.in_training(F.col("slot")).alias("in_train")))


@query
def ols_fit(spark, folder):
    days = demand.mode_table(tables.mode_days(spark, folder), tables.MODES)
    fitted = regression.coefficient_frame(spark, demand.fit_daily(days, FEATURES, TARGET), FEATURES)
    return fitted.withColumn("coefficient", F.round("coefficient", 5))


@query
def ols_holdout(spark, folder):
    days = demand.mode_table(tables.mode_days(spark, folder), tables.MODES)
    return demand.holdout_daily(days, FEATURES, TARGET)


@query
def ols_trend(spark, folder):
    return regression.trend(tables.mode_days(spark, folder))


def route_days(spark, folder):
    rides = tables.ridership(spark, folder)
    return rides.groupBy("bus_route", clock.day_slot(F.col("transit_timestamp")).alias("slot")).agg(
        F.sum("ridership").alias("riders"), F.sum("transfers").alias("transfers"), F.count(F.lit(1)).alias("rides")
    )


@query
def ols_by_series(spark, folder):
    """Riders a day on rides and transfers, one regression per route."""
    fits = regression.fit_by_series(route_days(spark, folder), "bus_route", ["rides", "transfers"], "riders")
    return fits.withColumn("coefficient", F.round("coefficient", 5))


@query
def ols_forecast(spark, folder):
    days = demand.mode_table(tables.mode_days(spark, folder), tables.MODES)
    return demand.project_daily(days, FEATURES, TARGET, PROJECTED_DAYS)


# --- trips --------------------------------------------------------------------------------------------


def located(spark, folder):
    return trip_insight.locate(tables.trip_requests(spark, folder), tables.stops(spark, folder))


def matched_trips(spark, folder):
    return joins.matched(located(spark, folder))


def route_profile(spark, folder):
    return trip_insight.route_profile(hours_by(spark, folder, "bus_route"))


def bundled(spark, folder):
    """Located trips feed four branches of the bundle, so they are written once."""
    return trip_insight.bundle(
        stage(matched_trips(spark, folder), run_folder(spark, "trips")),
        tables.flow_snapshots(spark, folder),
        tables.incidents(spark, folder),
        route_profile(spark, folder),
    )


def scored_trips(spark, folder):
    return trip_insight.scored(bundled(spark, folder))


@query
def trip_endpoints(spark, folder):
    return matched_trips(spark, folder).select(
        "request_id", "dep_stop", "dep_lat", "dep_lng", "dst_stop", "dst_lat", "dst_lng"
    )


@query
def trip_unmatched(spark, folder):
    return joins.unmatched(located(spark, folder)).select("request_id", "dep_stop", "dst_stop", "unknown")


@query
def trip_bbox(spark, folder):
    return trip_insight.with_box(matched_trips(spark, folder)).select("request_id", "south", "west", "north", "east")


@query
def arrival_resolved(spark, folder):
    return insight.with_arrival(tables.trip_requests(spark, folder)).select(
        "request_id", "requested_at", "arrive_by", "arrival_at", "hours_ahead", "long_horizon"
    )


@query
def arrival_iso(spark, folder):
    return insight.with_arrival(tables.trip_requests(spark, folder)).select(
        "request_id",
        clock.iso_utc(F.col("arrival_at")).alias("utc_text"),
        clock.iso_utc(F.col("arrival_at"), "America/New_York").alias("new_york_as_utc"),
    )


@query
def trip_distance(spark, folder):
    return insight.with_distance(matched_trips(spark, folder)).select("request_id", "miles")


@query
def trip_co2_saved(spark, folder):
    return insight.with_distance(matched_trips(spark, folder)).select(
        "request_id", impact.trip_pounds_saved(F.col("miles")).alias("pounds_saved")
    )


@query
def trip_savings(spark, folder):
    miles = insight.with_distance(matched_trips(spark, folder))
    return miles.select("request_id", money.trip_savings_cents(F.col("miles")).alias("savings_cents"))


@query
def flow_asof(spark, folder):
    return trip_insight.flow_at_endpoints(matched_trips(spark, folder), tables.flow_snapshots(spark, folder))


@query
def incidents_in_bbox(spark, folder):
    pairs = trip_insight.incidents_on_way(matched_trips(spark, folder), tables.incidents(spark, folder))
    return pairs.select("request_id", "incident_id", "icon_category", "lat", "lng")


@query
def incident_categories(spark, folder):
    return trip_insight.incident_categories(matched_trips(spark, folder), tables.incidents(spark, folder))


@query
def incident_load(spark, folder):
    return trip_insight.incident_load(matched_trips(spark, folder), tables.incidents(spark, folder))


@query
def flow_nearest(spark, folder):
    """Traffic at places that are no stops: at the stop nearest to each."""
    e = F.col("request_id")
    asked = tables.trip_requests(spark, folder).select(
        "request_id",
        "requested_at",
        (F.lit(32.5) + (e * 17 % 8000) * F.lit(0.0001)).alias("lat"),
        (F.lit(-80.3) + (e * 29 % 6000) * F.lit(0.0001)).alias("lng"),
    )
    found = trip_insight.flow_at_points(asked, tables.stops(spark, folder), tables.flow_snapshots(spark, folder))
    return found.select("request_id", "stop_id", "degrees", "mph", "free_mph")


@query
def trip_ridership(spark, folder):
    return trip_insight.ridership_ahead(matched_trips(spark, folder), route_profile(spark, folder)).select(
        "request_id", "route", "hours_ahead", "predicted_riders"
    )


@query
def traffic_bundle(spark, folder):
    named = lambda e: F.format_string("%02d:%d", e["key"], e["value"])
    nested = trip_insight.nested_bundle(bundled(spark, folder))
    return nested.select(
        "request_id",
        F.col("traffic.flow.current.mph").alias("dep_mph"),
        F.col("traffic.flow.destination.mph").alias("dst_mph"),
        F.col("traffic.incidents.total").alias("incidents"),
        F.array_join(F.array_sort(F.transform(F.map_entries("traffic.incidents.byCategory"), named)), ",").alias("by_category"),
        F.col("traffic.ridership.predictedHourly").alias("predicted_riders"),
    )


@query
def trip_density(spark, folder):
    return scored_trips(spark, folder).select("request_id", "flow_percent", "incidents", "density")


@query
def trip_travel_time(spark, folder):
    return scored_trips(spark, folder).select("request_id", "miles", "travel_minutes")


@query
def be_at_stop(spark, folder):
    return scored_trips(spark, folder).select(
        "request_id", "be_at_stop", clock.clock12(F.col("be_at_stop")).alias("be_at_stop_text")
    )


@query
def incentive_by_density(spark, folder):
    mixed = F.when(F.col("request_id") % 2 == 0, F.upper("density")).otherwise(F.col("density"))
    return scored_trips(spark, folder).select("request_id", money.incentive_usd(mixed).alias("incentive_usd"))


@query
def incentive_typed(spark, folder):
    return scored_trips(spark, folder).select(
        "request_id",
        F.col("incentive.type").alias("type"),
        F.col("incentive.description").alias("description"),
        F.col("incentive.value").alias("value"),
    )


@query
def nudge_text(spark, folder):
    return scored_trips(spark, folder).select("request_id", "nudge")


@query
def trip_display(spark, folder):
    return insight.display(scored_trips(spark, folder))


@query
def complete_trips(spark, folder):
    kept = quality.complete(scored_trips(spark, folder), ["savings_cents", "density", "travel_minutes"])
    return kept.select("request_id", "savings_cents", "density", "travel_minutes")


@query
def runner_up_rides(spark, folder):
    others = trip_insight.complete_rides(trip_insight.with_other_rides(scored_trips(spark, folder)))
    text = F.transform(
        "next_rides",
        lambda r: F.concat_ws(
            ":", r["request_id"].cast("string"), r["travel_minutes"].cast("string"), r["arrive_by"]
        ),
    )
    return others.select("request_id", "dst_id", "density", "travel_minutes", F.array_join(text, ";").alias("next_rides"))


@query
def topk_rides(spark, folder):
    offered = trip_insight.complete_rides(scored_trips(spark, folder))
    best = rides.first_k(offered.select("dst_id", "request_id", "travel_minutes"), ["dst_id"], ["travel_minutes", "request_id"], 3)
    return best.withColumn("position", F.col("position").cast("bigint"))


@query
def trip_insights(spark, folder):
    nested = trip_insight.response(trip_insight.with_other_rides(scored_trips(spark, folder)))
    rides_text = F.transform(
        "additionalRides",
        lambda r: F.struct(
            r["departureTime"].alias("departure_time"),
            r["travelTime"].alias("travel_minutes"),
            r["trafficDensity"].alias("density"),
        ),
    )
    return nested.select(
        "request_id",
        F.col("travelTime").alias("travel_minutes"),
        F.col("trafficDensity").alias("density"),
        F.col("costSavingsPerTrip").alias("savings"),
        F.col("nudgeMessage").alias("nudge"),
        F.col("incentiveDetails.type").alias("incentive_type"),
        F.col("incentiveDetails.value").alias("incentive_value"),
        insight.ride_list_text(rides_text).alias("other_rides"),
    )


@query
def insights_from_json(spark, folder):
    accepted, _ = trip_insight.locate_bodies(tables.request_bodies(spark, folder), tables.stops(spark, folder))
    trips = trip_insight.insights_of(
        accepted,
        tables.flow_snapshots(spark, folder),
        tables.incidents(spark, folder),
        route_profile(spark, folder),
        folder=run_folder(spark, "insights"),
    )
    return trips.select("request_id", "dep_stop", "dst_stop", "travel_minutes", "density", "savings_cents", "nudge")


@query
def travel_time_results(spark, folder):
    trips = trip_insight.with_other_rides(scored_trips(spark, folder))
    return trip_insight.travel_time_response(trips).select(
        "request_id",
        F.col("travelTime").alias("travel_minutes"),
        F.col("trafficDensity").alias("density"),
        F.col("costSavingsPerTrip").alias("savings"),
        F.size("additionalRides").cast("bigint").alias("n_rides"),
        F.to_json("additionalRides").alias("rides"),
    )


# --- impact -------------------------------------------------------------------------------------------


@query
def emission_factors(spark, folder):
    return impact.observed_factors(tables.vehicle_runs(spark, folder))


@query
def rider_emissions(spark, folder):
    return impact.commute_emissions(tables.riders(spark, folder))


@query
def cost_index_long(spark, folder):
    return impact.cost_index_long(tables.cost_texts(spark, folder))


# --- files and services -------------------------------------------------------------------------------


def hourly_files(spark, folder):
    """The ridership text as CSV files with two orders of columns; every 89th rider count is no number."""
    rows = tables.ridership_text(spark, folder).withColumn(
        "ridership", F.when(F.col("event_id") % 89 == 0, F.lit("many")).otherwise(F.col("ridership").cast("string"))
    )
    path = run_folder(spark, "hourly-csv")
    names = ["transit_timestamp", "bus_route", "payment_method", "fare_class_category", "ridership", "transfers"]
    for part, order in enumerate((names, names[::-1])):
        half = rows.filter(F.col("event_id") % 2 == part).select(*order)
        half.write.option("header", True).csv(f"{path}/layout={part}")
    return f"{path}/*"


@query
def hourly_csv_scan(spark, folder):
    good, _ = readers.read_hourly(spark, hourly_files(spark, folder))
    return good


@query
def hourly_csv_quarantine(spark, folder):
    _, bad = readers.read_hourly(spark, hourly_files(spark, folder))
    return bad.groupBy("error", "details").agg(F.count(F.lit(1)).alias("n"))


DAILY_MEASURES = ("Buses: Total Riders", "Buses: % of Day")


def daily_files(spark, folder):
    """Order days as wide CSV files with two orders of columns; some dates and numbers are unreadable, some empty."""
    day = F.date_from_unix_date(F.col("slot").cast("int"))
    slot, total, share = F.col("slot"), F.format_string("%.2f", "y"), F.pmod("slot", F.lit(100)).cast("string")
    rows = tables.order_days(spark, folder).select(
        "slot",
        F.when(slot % 41 == 0, F.lit("someday")).otherwise(F.date_format(day, "MM/dd/yyyy")).alias("Date"),
        F.when(slot % 37 == 0, F.lit("n/a")).otherwise(total).alias(DAILY_MEASURES[0]),
        F.when(slot % 10 != 0, share).alias(DAILY_MEASURES[1]),
        F.lit("x").alias("Subways: Total"),
    )
    path = run_folder(spark, "daily-csv")
    names = ["Date", "Subways: Total", *DAILY_MEASURES]
    for part, order in enumerate((names, names[::-1])):
        half = rows.filter(F.col("slot") % 2 == part).select(*[F.col(f"`{c}`") for c in order])
        half.write.option("header", True).csv(f"{path}/layout={part}")
    return f"{path}/*"


@query
def daily_csv_scan(spark, folder):
    good, _ = readers.read_daily(spark, daily_files(spark, folder), DAILY_MEASURES)
    return good


@query
def daily_csv_quarantine(spark, folder):
    _, bad = readers.read_daily(spark, daily_files(spark, folder), DAILY_MEASURES)
    return bad


@query
def forecast_table_round_trip(spark, folder):
    path = run_folder(spark, "forecasts")
    sinks.write_forecasts(demand.hourly_forecast(tables.ridership(spark, folder), "bus_route", HORIZON), path)
    return at_hour(spark.read.parquet(path))


@query
def error_round_trip(spark, folder):
    """Error records of two runs, the first of which is written twice."""
    path = run_folder(spark, "errors")
    _, errors = trip_insight.locate_bodies(tables.request_bodies(spark, folder), tables.stops(spark, folder))
    for run, part in (("first", errors), ("second", errors.filter("request_id % 2 = 0")), ("first", errors)):
        sinks.write_errors(part, path, run)
    kept = spark.read.schema("error string, details string, payload string, run string").json(path)
    return kept.groupBy("run", "error", "details").agg(F.count(F.lit(1)).alias("n"))


@query
def partitioned_forecast_round_trip(spark, folder):
    """Forecasts in folders by run and series, written twice under one run."""
    path = run_folder(spark, "forecasts")
    table = demand.hourly_forecast(tables.ridership(spark, folder), "bus_route", HORIZON)
    for _ in range(2):
        sinks.write_run(table, path, "nightly", by=["series_key"])
    return at_hour(spark.read.parquet(path).drop("run"))


@query
def insight_round_trip(spark, folder):
    path = run_folder(spark, "insights")
    sinks.write_insights(trip_insight.response(trip_insight.with_other_rides(scored_trips(spark, folder))), path, "json")
    kept = spark.read.schema("request_id bigint, travelTime bigint, trafficDensity string, nudgeMessage string").json(path)
    return kept.withColumnsRenamed({"travelTime": "travel_minutes", "trafficDensity": "density", "nudgeMessage": "nudge"})


@query
def login_report(spark, folder):
    checked = quality.apply_rules(tables.registrations(spark, folder), quality.login_rules())
    return checked.select("record_id", "accepted", joined("reasons").alias("reasons"))


@query
def standard_emissions(spark, folder):
    """Riders' commute, ridden by bus or car, with the table of standard factors."""
    factors = impact.mode_factors(spark)
    riders = tables.riders(spark, folder).withColumn(
        "mode", F.when(F.col("rider_id") % 2 == 0, F.lit("bus")).otherwise(F.lit("car"))
    )
    grams = F.round(F.col("miles_per_day") * F.col("grams_per_mile") / F.col("passengers"), 4)
    return riders.join(factors, "mode").select("rider_id", "mode", grams.alias("daily_grams"))


def mean_model(values, horizon):
    """A user's own model: the mean of what was seen, between the least and the greatest value."""
    import pandas as pd

    return pd.DataFrame(
        {"step": range(1, horizon + 1), "q10": float(values.min()), "q50": float(values.mean()), "q90": float(values.max())}
    )


@query
def forecast_own_model(spark, folder):
    made = forecast.forecast_with_model(hours_by(spark, folder, "payment_method"), HORIZON, mean_model)
    return made.select("series_key", "step", *[F.round(c, 4).alias(c) for c in ("q10", "q50", "q90")])


# --- streaming ----------------------------------------------------------------------------------------


def stream_of_events(spark, folder):
    # A pattern, because a stream's plain path must be a directory and the table may be a single file.
    schema = tables.table(spark, folder, "events").schema
    return jobs.history_stream(spark, f"{folder}/events.parque[t]", schema)


@query
def stream_hourly(spark, folder):
    """All hours come from what the stream wrote, batch by batch."""
    rows = stream_of_events(spark, folder).withColumn("ridership", F.floor("value").cast("bigint"))
    base = run_folder(spark, "hourly")
    jobs.sums_by_batch(rows, "event_type", "ts", "ridership", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return jobs.hours_so_far(spark, f"{base}/out").drop("corrected")


def resent_events(spark, folder, run):
    """All events in three slices by time, each followed by a slice that resends what came last in it. ``run`` starts a
    job over the landing folder on one checkpoint. It runs once per slice, which it reads as one batch, in however many
    files the slice was written: the watermark only moves past rows that have all been read."""
    events = tables.table(spark, folder, "events")
    path = run_folder(spark, "landing")
    first, last = (F.unix_seconds(f(F.col("ts").cast("timestamp"))) for f in (F.min, F.max))
    low, high = events.agg(first, last).first()
    edge = [low + (high + 1 - low) * i // 3 for i in range(4)]
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    starts = [s for i in range(3) for s in (edge[i], edge[i + 1] - 1800)]
    for i, start in enumerate(starts):
        events.filter((at >= start) & (at < edge[i // 2 + 1])).write.parquet(f"{path}/slice={i}")
        run(jobs.history_stream(spark, f"{path}/*", events.schema)).awaitTermination()


@query
def stream_unique_requests(spark, folder):
    base = run_folder(spark, "unique")

    def run(events):
        unique = jobs.without_resends(events, "event_id", "ts")
        kept = unique.select(F.col("event_id").alias("request_id"), "ts")
        return jobs.append_to(kept, f"{base}/out", f"{base}/checkpoint")

    resent_events(spark, folder, run)
    return spark.read.schema("request_id bigint, ts timestamp_ntz").parquet(f"{base}/out")


@query
def stream_trip_insights(spark, folder):
    """Requests without resends, each micro-batch through the batch plan; rejects come back next to insights. What batches
    look up is derived once. A batch is evaluated once, as located requests; one without any has nothing to look up."""
    stops, known = tables.stops(spark, folder), run_folder(spark, "known")
    flows = stage(tables.flow_snapshots(spark, folder), f"{known}/flows")
    hazards = stage(tables.incidents(spark, folder), f"{known}/incidents")
    profile = stage(route_profile(spark, folder), f"{known}/profile")
    schema = "request_id bigint, travel_minutes bigint, density string, savings_cents bigint, nudge string"

    def transform(batch):
        asked = tables.requests_of(batch, tables.table(spark, folder, "supplier"))
        place = stage(trip_insight.locate(asked, stops), run_folder(spark, "batch"))
        trips = joins.matched(place)
        if trips.isEmpty():
            answered = place.sparkSession.createDataFrame([], schema)
        else:
            names = ["request_id", "travel_minutes", "density", "savings_cents", "nudge"]
            answered = trip_insight.insights_in_parts(trips, flows, hazards, profile, names, run_folder(spark, "answered"))
        rejected = joins.unmatched(place).select(
            "request_id",
            F.lit("Unknown stop").alias("error"),
            F.col("unknown").alias("details"),
            F.to_json(F.struct("request_id", "dep_stop", "dst_stop")).alias("payload"),
        )
        return answered, rejected

    base = run_folder(spark, "insights")

    def run(events):
        unique = jobs.without_resends(events, "event_id", "ts")
        return jobs.per_batch(unique, transform, f"{base}/accepted", f"{base}/rejected", f"{base}/checkpoint")

    resent_events(spark, folder, run)
    accepted = spark.read.schema(schema).parquet(f"{base}/accepted/batch_id=*")
    rejected = spark.read.schema("request_id bigint, details string").json(f"{base}/rejected/batch_id=*")
    return accepted.withColumn("rejected", F.lit(None).cast("string")).unionByName(
        rejected.select("request_id", F.col("details").alias("rejected")), allowMissingColumns=True
    )
