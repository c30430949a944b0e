from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from commutelens.functions import jsons
from commutelens.operators import impact, insight, quality
from commutelens.plans import trip_insight
from commutelens.schemas import TRIP_REQUEST


def test_requests_are_split_without_loss(rows):
    bodies = [
        '{"departure":{"lat":1,"lng":2},"destination":{"lat":1,"lng":2},"timeToDestination":"14:30"}',
        '{"departure":null,"destination":{"lat":1,"lng":2},"timeToDestination":"14:30"}',
        '{"destination":{"lat":1,"lng":2},"timeToDestination":""}',
        '{"departure":',
        "{}",
        None,
    ]
    df = jsons.with_parsed(rows([(i, b) for i, b in enumerate(bodies)], "id bigint, body string"), "body", TRIP_REQUEST, "request")
    good, bad = quality.split(quality.apply_rules(df, quality.request_rules()))
    assert [r["id"] for r in good.collect()] == [0]
    reasons = {r["id"]: r["reasons"] for r in bad.collect()}
    everything = ["departure", "destination", "timeToDestination"]
    assert reasons == {1: ["departure"], 2: ["departure", "timeToDestination"], 3: everything, 4: everything, 5: everything}


def test_registration_rules(rows):
    df = rows(
        [(1, "Ann", "a@b.org", "x", "x"), (2, "", "a@b", "x", "y"), (3, None, None, None, None), (4, "Bo", "a b@c.de", "", "")],
        "id bigint, name string, email string, password string, confirm_password string",
    )
    got = {r["id"]: r["reasons"] for r in quality.apply_rules(df, quality.registration_rules()).collect()}
    assert got[1] == []
    assert got[2] == ["name", "email", "password_match"]
    assert got[3] == ["name", "email", "password", "confirm"]
    assert got[4] == ["email", "password", "confirm"]


def test_login_rules(rows):
    df = rows([("a@b.org", "x"), ("a@b.org", "")], "email string, password string")
    assert [r["accepted"] for r in quality.apply_rules(df, quality.login_rules()).collect()] == [True, False]


def test_responses(rows):
    texts = [
        '{"travelTime":5,"trafficDensity":"Light","incentiveDetails":{"type":"cash"}}',
        '{"travelTime":null,"trafficDensity":"Severe"}',
        '{"travelTime":5',
        "{}",
    ]
    df = rows([(i, t) for i, t in enumerate(texts)], "id bigint, response string")
    parsed = quality.parse_responses(df)
    assert [r["error"] is None for r in parsed.orderBy("id").collect()] == [True, True, False, True]
    gaps = {r["id"]: (r["missing"], r["missing_incentive"]) for r in quality.response_gaps(df).collect()}
    assert gaps[0] == (["costSavingsPerTrip", "nudgeMessage"], ["description", "value"])
    assert gaps[1] == (["costSavingsPerTrip", "nudgeMessage", "incentiveDetails"], None)
    assert gaps[2] == (None, None) and len(gaps[3][0]) == 5
    rules = quality.enum_rules(F.col("insight.trafficDensity"), F.col("insight.incentiveDetails.type"))
    broken = {r["id"]: r["reasons"] for r in quality.apply_rules(parsed, rules).collect()}
    assert broken == {0: ["incentiveType"], 1: ["trafficDensity"], 2: [], 3: []}


def test_zero_counts_as_missing(rows):
    df = rows([(1, 80, "Light", 5), (2, 0, "Light", 5), (3, 80, None, 5), (4, 80, "", 5), (5, 80, "Heavy", None)], "id bigint, s bigint, d string, t bigint")
    assert [r["id"] for r in quality.complete(df, ["s", "d", "t"]).collect()] == [1]


@pytest.mark.parametrize(
    ("flow", "incidents", "expected"),
    [(80, 0, "Light"), (79, 0, "Medium"), (50, 2, "Medium"), (49, 0, "Heavy"), (100, 3, "Medium"), (60, 3, "Heavy"), (10, 9, "Heavy"), (None, 9, None)],
)
def test_density(rows, flow, incidents, expected):
    df = rows([(flow, incidents)], "f bigint, i bigint")
    assert df.select(insight.density(F.col("f"), F.col("i"))).first()[0] == expected


def test_trip_results_within_bounds(rows):
    df = rows(
        [(1, 10.0, 40, 40, 20, 40, 0), (2, 10.0, None, None, 2, 40, 0), (3, 10.0, None, None, None, None, 0), (4, 0.0, 40, 40, 40, 40, 0)],
        "request_id bigint, miles double, dep_mph bigint, dep_free_mph bigint, dst_mph bigint, dst_free_mph bigint, incidents bigint",
    )
    got = {r["request_id"]: r for r in insight.with_traffic_result(df).collect()}
    assert (got[1]["travel_minutes"], got[1]["density"]) == (30, "Medium")
    assert (got[2]["travel_minutes"], got[2]["density"]) == (120, "Heavy")
    assert (got[3]["travel_minutes"], got[3]["density"]) == (None, None)
    assert got[4]["travel_minutes"] == 0 and got[4]["savings_cents"] == 0


def test_typed_incentive_stays_in_its_range(rows):
    df = rows([(i, d) for i in range(6) for d in ("Light", "Medium", "Heavy", None)], "id bigint, d string")
    got = df.select("d", insight.typed_incentive(F.col("id"), F.col("d")).alias("x")).collect()
    assert {r["x"]["type"] for r in got if r["x"]} == {"eCredit", "partnerDiscount", "funReward"}
    assert all((r["x"] is None) == (r["d"] is None) for r in got)
    assert all(0.5 <= float(r["x"]["value"][1:]) <= 2.0 for r in got if r["x"])


def test_be_at_stop_leaves_a_buffer(rows):
    df = rows([("2024-01-01 10:00:00", 25), ("2024-01-01 00:03:00", 5)], "now timestamp_ntz, m bigint")
    got = [str(r[0]) for r in df.select(insight.be_at_stop(F.col("now"), F.col("m"))).collect()]
    assert got == ["2024-01-01 10:15:00", "2023-12-31 23:58:00"]


def test_ride_list_text(rows):
    df = rows([(1,)], "id bigint").select(
        F.array(
            F.struct(F.lit("08:00").alias("departure_time"), F.lit(20).alias("travel_minutes"), F.lit("Light").alias("density")),
            F.struct(F.lit(None).cast("string").alias("departure_time"), F.lit(25).alias("travel_minutes"), F.lit("Light").alias("density")),
        ).alias("r")
    )
    assert df.select(insight.ride_list_text(F.col("r"))).first()[0] == "08:00 20 mins Light; 25 mins Light"
    assert df.select(insight.ride_list_text(F.slice("r", 1, 0))).first()[0] is None


def test_riders_are_those_known_on_the_day_of_the_request(rows):
    day = 19_723 * 24  # 2024-01-01
    history = rows(
        [("R1", day + 9, 10), ("R1", day + 24 + 9, 20), ("R1", day + 48 + 9, 90), ("R1", day + 10, 7)], "series_key string, slot bigint, y bigint"
    )
    trips = rows(
        [
            (1, "R1", "2024-01-03 08:00:00", "2024-01-03 09:30:00", 1),  # two days known: median of 10 and 20
            (2, "R1", "2024-01-09 08:00:00", "2024-01-09 09:30:00", 1),  # all three
            (3, "R1", "2024-01-01 23:00:00", "2024-01-02 09:30:00", 10),  # nothing before its own day
            (4, "R1", "2024-01-09 09:00:00", "2024-01-09 09:30:00", 0),  # within the hour
            (5, "R9", "2024-01-09 08:00:00", "2024-01-09 09:30:00", 1),
            (6, None, "2024-01-09 08:00:00", "2024-01-09 09:30:00", 1),
            (7, "R1", "2024-01-02 00:00:00", "2024-01-02 10:00:00", 10),
        ],
        "request_id bigint, route string, requested_at timestamp_ntz, arrival_at timestamp_ntz, hours_ahead bigint",
    )
    profile = trip_insight.route_profile(history)
    got = {r["request_id"]: r["predicted_riders"] for r in trip_insight.ridership_ahead(trips, profile).collect()}
    assert got == {1: 15, 2: 20, 3: None, 4: None, 5: None, 6: None, 7: 7}


def test_bundle_folds_what_was_found_under_each_request(rows):
    at = "2024-01-05 10:00:00"
    trips = rows(
        [(1, at, "2024-01-05 12:00:00", 2, "R1", 1, 2, 1.0, 1.0, 2.0, 2.0), (2, at, "2024-01-05 12:00:00", 2, "R2", 3, 3, 8.0, 8.0, 9.0, 9.0)],
        "request_id bigint, requested_at timestamp_ntz, arrival_at timestamp_ntz, hours_ahead bigint, route string, dep_id bigint, dst_id bigint, "
        "dep_lat double, dep_lng double, dst_lat double, dst_lng double".replace(", ", ","),
    )
    flows = rows([(1, 1, "2024-01-05 09:00:00", 20, 40), (2, 1, "2024-01-05 11:00:00", 1, 40), (3, 2, "2024-01-04 09:00:00", 30, 40)], "flow_id bigint,stop_id bigint,observed_at timestamp_ntz,mph bigint,free_mph bigint")
    schema = "lat double,lng double,valid_from timestamp_ntz,valid_to timestamp_ntz,icon_category bigint"
    hazards = rows([(1.5, 1.5, "2024-01-05 09:00:00", None, 3)] * 2 + [(1.0, 2.0, "2024-01-05 09:00:00", "2024-01-05 10:30:00", None), (1.5, 1.5, "2024-01-05 11:00:00", None, 4)], schema)
    profile = trip_insight.route_profile(rows([("R1", 19_724 * 24 + 12, 33)], "series_key string,slot bigint,y bigint"))
    got = {r["request_id"]: r for r in trip_insight.bundle(trips, flows, hazards, profile).collect()}
    assert (got[1]["dep_mph"], got[1]["dst_mph"], got[1]["predicted_riders"]) == (20, 30, 33)
    assert got[1]["incidents"] == 3 and got[1]["incidents_by_category"] == {3: 2, -1: 1} and got[1]["route"] == "R1"
    assert (got[2]["dep_mph"], got[2]["incidents"], got[2]["incidents_by_category"], got[2]["predicted_riders"]) == (None, 0, {}, None)
    nothing = trip_insight.bundle(trips, flows.limit(0), hazards.limit(0), profile.limit(0)).collect()
    assert len(nothing) == 2 and all(r["incidents"] == 0 for r in nothing)


def test_standard_commute_emissions(rows):
    got = impact.commute_emissions(rows([(1, 20, 250)], "rider_id bigint, miles_per_day bigint, days_per_year bigint")).first()
    assert (got["bus_daily_grams"], got["car_daily_grams"]) == (1786.6667, 5386.6667)
    assert (got["bus_annual_kg"], got["car_annual_kg"]) == (446.6667, 1346.6667)
    assert (got["daily_grams_saved"], got["annual_kg_saved"], got["percent_saved"]) == (3600.0, 900.0, 66.8317)


def test_reference_tables(spark):
    factors = {r["mode"]: round(r["grams_per_passenger_mile"], 2) for r in impact.mode_factors(spark).collect()}
    assert factors == {"bus": 89.33, "car": 269.33}
    assert impact.cost_factors(spark).count() == 10


def test_cost_text(rows):
    texts = rows([("fuel", "100%", "10% (in the fare)"), ("air", "Higher (100%)", "Lower (30%)"), ("x", "0%", "5%")], "criterion string, car_text string, bus_text string")
    got = {(r["criterion"], r["mode"]): (r["percent"], r["saving_percent"]) for r in impact.cost_index_long(texts).collect()}
    assert got["fuel", "bus"] == (10, 90.0) and got["air", "car"] == (100, 70.0) and got["x", "bus"] == (5, None)
