"""Trip request to insight, as one lazy plan.

Order of work: cheap checks and the stop lookup drop bad requests first; flow, incidents and ridership are
then looked up for what is left, each keyed by request, and joined one to one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.functions import clock, geo, jsons, money, numeric
from commutelens.operators import boxsums, forecast, insight, joins, quality, rides
from commutelens.params import TRIP, TripParams
from commutelens.schemas import TRIP_REQUEST
from commutelens.session import shuffles_let_go, stage


def locate(requests: DataFrame, stops: DataFrame) -> DataFrame:
    return joins.endpoints(insight.with_arrival(requests), stops)


def judge_bodies(bodies: DataFrame, stops: DataFrame) -> DataFrame:
    """Requests as JSON text (``body``, with ``request_id, requested_at, rider_id, route``), each located as far as it
    can be and with ``error`` and ``details``, null for good ones: fields that are missing or unreadable, or places
    that are no stop. One row per request, parsed once."""
    parsed = jsons.with_parsed(bodies, "body", TRIP_REQUEST, "request")
    asked = quality.apply_rules(parsed, quality.request_rules()).select(
        "request_id",
        "requested_at",
        "rider_id",
        "route",
        "body",
        "accepted",
        "reasons",
        F.col("request.departure.lat").alias("dep_lat"),
        F.col("request.departure.lng").alias("dep_lng"),
        F.col("request.destination.lat").alias("dst_lat"),
        F.col("request.destination.lng").alias("dst_lng"),
        F.col("request.timeToDestination").alias("arrive_by"),
    )
    located = joins.endpoints_by_place(insight.with_arrival(asked), stops)
    lost = joins.unknown_ends()
    return located.withColumns(
        {
            "error": F.when(~F.col("accepted"), F.lit("Missing required fields")).when(lost != "", F.lit("Unknown stop")),
            "details": F.when(~F.col("accepted"), F.array_join("reasons", ",")).when(lost != "", lost),
        }
    ).drop("accepted", "reasons")


def locate_bodies(bodies: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON requests as (matched requests, error records); every request is in one of them."""
    judged = judge_bodies(bodies, stops)
    errors = judged.filter(F.col("error").isNotNull())
    return (
        judged.filter(F.col("error").isNull()).drop("error", "details", "body"),
        errors.select("request_id", "error", "details", F.col("body").alias("payload")),
    )


def with_box(trips: DataFrame) -> DataFrame:
    return trips.withColumns(geo.bounding_box(F.col("dep_lat"), F.col("dep_lng"), F.col("dst_lat"), F.col("dst_lng")))


def _flows_by_side(trips: DataFrame, flows: DataFrame) -> DataFrame:
    """(request_id, side, mph, free_mph): speed last seen at both ends of each trip, by one as-of join."""
    ends = F.array(
        F.struct(F.lit("dep").alias("side"), F.col("dep_id").alias("stop_id")),
        F.struct(F.lit("dst").alias("side"), F.col("dst_id").alias("stop_id")),
    )
    probes = trips.select("request_id", "requested_at", F.inline(ends))
    found = joins.as_of(probes, flows, "stop_id", "requested_at", "observed_at", "flow_id", ["mph", "free_mph"])
    return found.select("request_id", "side", "mph", "free_mph")


def _both_sides() -> list:
    return [
        F.max(F.when(F.col("side") == side, F.col(value))).alias(f"{side}_{value}")
        for side in ("dep", "dst")
        for value in ("mph", "free_mph")
    ]


def flow_at_endpoints(trips: DataFrame, flows: DataFrame) -> DataFrame:
    """Speed last seen at both ends of each trip, one row per request."""
    return _flows_by_side(trips, flows).groupBy("request_id").agg(*_both_sides())


def flow_at_points(points: DataFrame, stops: DataFrame, flows: DataFrame) -> DataFrame:
    """Points with ``request_id, requested_at, lat, lng``, each with its nearest stop (``stop_id``, ``degrees`` away) and
    the speed last seen there; nulls where a point has no place or the stop no observation."""
    near = joins.nearest(points, stops.select("stop_id", "lat", "lng"), "request_id", "stop_id")
    return joins.as_of(near, flows, "stop_id", "requested_at", "observed_at", "flow_id", ["mph", "free_mph"]).drop("fact_time")


def incidents_on_way(trips: DataFrame, incidents: DataFrame) -> DataFrame:
    return joins.boxes_with_points(_way(trips), incidents, "requested_at", "valid_from", "valid_to")


def incident_load(trips: DataFrame, incidents: DataFrame) -> DataFrame:
    """Number of incidents per request that meets any.

    A polled feed reports the same incident again and again: equal places and times are counted first.
    """
    counted = incidents.groupBy("lat", "lng", "valid_from", "valid_to").agg(F.count(F.lit(1)).alias("incidents"))
    return boxsums.totals_in_boxes(_way(trips), counted, "request_id", "requested_at", "valid_from", "valid_to", ["incidents"])


#: Categories that are counted in one go, a column each.
CATEGORIES_AT_ONCE = 32


def _counts_by_category(trips: DataFrame, incidents: DataFrame) -> DataFrame:
    """(request_id, counts: array of category and number). Categories are a feed's few codes; their list is read first."""
    kinds = [r[0] for r in incidents.select("icon_category").distinct().orderBy("icon_category").collect()]
    found = []
    for at in range(0, max(1, len(kinds)), CATEGORIES_AT_ONCE):
        names = {f"_n{i}": F.lit(kind).cast("bigint") for i, kind in enumerate(kinds[at : at + CATEGORIES_AT_ONCE] or [None])}
        is_kind = {n: F.col("icon_category").eqNullSafe(kind) for n, kind in names.items()}
        counted = incidents.groupBy("lat", "lng", "valid_from", "valid_to").agg(*[F.count_if(c).alias(n) for n, c in is_kind.items()])
        totals = boxsums.totals_in_boxes(_way(trips), counted, "request_id", "requested_at", "valid_from", "valid_to", list(names))
        each = F.array(*[F.struct(kind.alias("icon_category"), F.col(n).alias("incidents")) for n, kind in names.items()])
        found.append(totals.select("request_id", F.filter(each, lambda c: c["incidents"] > 0).alias("counts")))
    return reduce(DataFrame.unionByName, found)


def incident_categories(trips: DataFrame, incidents: DataFrame) -> DataFrame:
    """Number of incidents per request and icon category, counted like ``incident_load``."""
    return _counts_by_category(trips, incidents).select("request_id", F.inline("counts"))


def _way(trips: DataFrame) -> DataFrame:
    return with_box(trips).select("request_id", "requested_at", "south", "west", "north", "east")


def feed_items(feeds: DataFrame, feed: str = "feed") -> DataFrame:
    """One row per incident of a feed text: the feed's columns, ``position``, what the engine reads of the incident, and
    ``item``, the incident as it came. Fields that nobody asked for are kept in it; those of another type are null."""
    listed = jsons.with_variant(feeds, feed, "_feed")
    each = listed.select(*feeds.columns, F.posexplode(jsons.at_path(F.col("_feed"), "$.incidents", "array<variant>")).alias("position", "item"))
    get = lambda path, kind: jsons.at_path(F.col("item"), path, kind)
    return each.withColumns(
        {
            "position": F.col("position").cast("bigint"),
            "type": get("$.type", "string"),
            "geometry_type": get("$.geometry.type", "string"),
            "lng": get("$.geometry.coordinates[0]", "double"),
            "lat": get("$.geometry.coordinates[1]", "double"),
            "icon_category": get("$.properties.iconCategory", "bigint"),
        }
    )


def feed_incidents(feeds: DataFrame, feed: str = "feed") -> DataFrame:
    """Incident rows from feed texts with ``valid_from`` and ``valid_to``, as the box operators take them; null as end
    means still open."""
    return feed_items(feeds, feed).select("lat", "lng", "icon_category", "valid_from", "valid_to")


def route_profile(history: DataFrame) -> DataFrame:
    """Riders to expect per route and hour of day as known from each day on, from an hourly series."""
    return forecast.profile_versions(history, forecast.HOURLY_PERIOD)


def _riders(trips: DataFrame, profile: DataFrame) -> DataFrame:
    """(request_id, predicted_riders) of requests that look ahead, from the days before the request's own."""
    at = lambda route, phase: F.concat_ws("/", F.lpad(phase.cast("string"), 2, "0"), route)
    facts = profile.select(
        at(F.col("series_key"), F.col("phase")).alias("route_hour"),
        clock.hour_of_slot(F.col("since")).alias("known_from"),
        "since",
        numeric.downward(F.col("q50")).alias("predicted_riders"),
    )
    probes = trips.filter((F.col("hours_ahead") > 0) & F.col("route").isNotNull()).select(
        "request_id", "requested_at", at(F.col("route"), F.hour("arrival_at")).alias("route_hour")
    )
    found = joins.as_of(probes, facts, "route_hour", "requested_at", "known_from", "since", ["predicted_riders"], 1440)
    return found.select("request_id", "predicted_riders")


def ridership_ahead(trips: DataFrame, profile: DataFrame) -> DataFrame:
    """Riders expected on the request's route at its arrival hour; nothing is looked up for an arrival within the hour."""
    return trips.join(_riders(trips, profile), "request_id", "left")


def bundle(trips: DataFrame, flows: DataFrame, incidents: DataFrame, profile: DataFrame) -> DataFrame:
    """Matched trips with flow at both ends, incidents by category and in all, and expected riders.

    What the lookups find is keyed by request, put under the trips and folded in one aggregation, so each of them moves
    once and no join follows another. ``request_id`` is unique. Incidents without a category count under -1.
    """
    names = [c for c in trips.columns if c != "request_id"]
    trip = trips.select("request_id", F.struct(*names).alias("trip"))
    kinds = F.transform("counts", lambda c: F.struct(F.coalesce(c["icon_category"], F.lit(-1).cast("bigint")), c["incidents"]))
    counts = _counts_by_category(trips, incidents).select("request_id", kinds.alias("kinds"))
    parts = (trip, _flows_by_side(trips, flows), counts, _riders(trips, profile))
    all_parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    folded = all_parts.groupBy("request_id").agg(
        F.first("trip", ignorenulls=True).alias("trip"),
        F.max("predicted_riders").alias("predicted_riders"),
        *_both_sides(),
        F.flatten(F.collect_list("kinds")).alias("kinds"),
    )
    by_category = F.map_from_entries("kinds")
    total = F.aggregate(F.map_values("incidents_by_category"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return (
        folded.select("request_id", "trip.*", "predicted_riders", *[f"{s}_{v}" for s in ("dep", "dst") for v in ("mph", "free_mph")], by_category.alias("incidents_by_category"))
        .withColumn("incidents", total)
    )


def nested_bundle(bundled: DataFrame) -> DataFrame:
    """The bundle as one nested traffic record per request."""
    return bundled.select(
        "request_id",
        F.struct(
            F.struct(
                F.struct(F.col("dep_mph").alias("mph"), F.col("dep_free_mph").alias("free_mph")).alias("current"),
                F.struct(F.col("dst_mph").alias("mph"), F.col("dst_free_mph").alias("free_mph")).alias("destination"),
            ).alias("flow"),
            F.struct(F.col("incidents").alias("total"), F.col("incidents_by_category").alias("byCategory")).alias("incidents"),
            F.struct(F.col("predicted_riders").alias("predictedHourly")).alias("ridership"),
        ).alias("traffic"),
    )


def scored(bundled: DataFrame, params: TripParams = TRIP) -> DataFrame:
    """Distance, travel time, traffic class, savings and the texts around them."""
    timed = insight.with_traffic_result(insight.with_distance(bundled), params)
    return insight.with_message(timed).withColumns(
        {
            "be_at_stop": insight.be_at_stop(F.col("requested_at"), F.col("travel_minutes"), params),
            "incentive_usd": money.incentive_usd(F.col("density"), params),
            "incentive": insight.typed_incentive(F.col("request_id"), F.col("density"), params),
        }
    )


def complete_rides(trips: DataFrame) -> DataFrame:
    """Trips that can be offered as rides: travel time and traffic class known and not zero."""
    return quality.complete(trips, ["travel_minutes", "density"])


def with_other_rides(trips: DataFrame, params: TripParams = TRIP, folder: str | None = None) -> DataFrame:
    """Runner-ups per trip: the next slower rides to the same stop in the same traffic class.

    Trips that are no complete rides have no runner-ups and are nobody's: without a traffic class they only
    share a group with their like, and a zero travel time sorts before every real one.
    """
    ranked = rides.following(
        trips, ["dst_id", "density"], "travel_minutes", "request_id", ["arrive_by"], params.runner_ups, folder=folder
    )
    is_ride = quality.truthy(trips, "travel_minutes") & quality.truthy(trips, "density")
    return ranked.withColumn("next_rides", F.when(is_ride, F.col("next_rides")))


def insights(
    requests: DataFrame,
    stops: DataFrame,
    flows: DataFrame,
    incidents: DataFrame,
    profile: DataFrame,
    params: TripParams = TRIP,
    folder: str | None = None,
) -> DataFrame:
    """Request rows, each with the ``route`` it asks about, to scored trips; requests with unknown stops are left to
    ``joins.unmatched``."""
    return insights_of(joins.matched(locate(requests, stops)), flows, incidents, profile, params, folder)


def insights_of(
    matched_trips: DataFrame,
    flows: DataFrame,
    incidents: DataFrame,
    profile: DataFrame,
    params: TripParams = TRIP,
    folder: str | None = None,
) -> DataFrame:
    """Located trips to scored trips.

    Located trips feed three lookups. A caller that names a shared folder has them written there once; without one the
    plan stays lazy. Results are the same.
    """
    if folder:
        matched_trips = stage(matched_trips, f"{folder}/trips")
    return scored(bundle(matched_trips, flows, incidents, profile), params)


#: Trips that are answered at once where a caller answers in parts.
TRIPS_AT_ONCE = 500_000


def insights_in_parts(
    matched_trips: DataFrame,
    flows: DataFrame,
    incidents: DataFrame,
    profile: DataFrame,
    columns: Sequence[str],
    folder: str,
    params: TripParams = TRIP,
    at_once: int = TRIPS_AT_ONCE,
) -> DataFrame:
    """``columns`` of all scored trips, ordered by time and answered about ``at_once`` at a time, each part written below
    ``folder``. A part looks up only what is known within its time, so that what is moved for it, and lies on disk until the
    part is done, follows the part's size and not that of the batch or the history. Trips should be written already."""
    at = clock.micros(F.col("requested_at"))
    count, first, last = matched_trips.agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
    cuts = []
    if (parts := -(-count // at_once)) > 1 and first is not None:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        cuts = matched_trips.agg(F.percentile_approx(at, shares, F.lit(100 * parts))).first()[0]
    edges = sorted({first, *cuts})
    written = []
    for i, low in enumerate(edges):
        high = edges[i + 1] - 1 if i + 1 < len(edges) else last
        part, seen, known = matched_trips, flows, incidents
        if low is not None:  # trips without a time go with the first
            part = matched_trips.filter(at.between(low, high) | (at.isNull() if not i else F.lit(False)))
            seen = joins.facts_between(flows, "stop_id", "observed_at", "flow_id", low, high)
            known = joins.points_between(incidents, "valid_from", "valid_to", low, high)
        answered = insights_of(part, seen, known, profile, params).select(*columns)
        with shuffles_let_go(answered.sparkSession):
            written.append(stage(answered, f"{folder}/part_{i:05d}"))
    return reduce(DataFrame.unionByName, written)


def response(trips: DataFrame) -> DataFrame:
    """Nested insight rows in the response contract, from scored trips with their runner-ups."""
    listed = F.transform(
        "next_rides",
        lambda r: F.struct(
            r["arrive_by"].alias("departureTime"),
            r["travel_minutes"].alias("travelTime"),
            F.col("density").alias("trafficDensity"),
        ),
    )
    return trips.select(
        "request_id",
        F.col("travel_minutes").alias("travelTime"),
        F.col("density").alias("trafficDensity"),
        money.dollars_text(F.col("savings_cents")).alias("costSavingsPerTrip"),
        F.col("nudge").alias("nudgeMessage"),
        F.col("incentive").alias("incentiveDetails"),
        F.coalesce(listed, F.array()).alias("additionalRides"),
    )


def travel_time_response(trips: DataFrame) -> DataFrame:
    """The shorter response without message and reward, for callers that only plan a trip."""
    return response(trips).select(
        "request_id", "travelTime", "trafficDensity", "costSavingsPerTrip", "additionalRides"
    )
