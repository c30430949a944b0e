from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from commutelens.operators import joins, series
from commutelens.plans import trip_insight
from commutelens.session import shared_folder
from commutelens.sources import readers, sinks, tables
from conftest import SMALL

HOURLY = """transit_timestamp,bus_route,payment_method,fare_class_category,ridership,transfers
03/09/2019 06:00:00 PM,L7,card,Adult,41,6
03/09/2019 12:00:00 AM,Route Unlisted,cash,Child,3,2
yesterday,K2,card,Adult,8,5
03/09/2019 09:00:00 AM,ZZZ,cash,Child,many,4
"""
REORDERED = """bus_route,ridership,transfers,transit_timestamp,fare_class_category,payment_method
M3,12,7,03/10/2019 01:00:00 PM,Adult,card
"""


def test_hourly_csv_with_quarantine(spark, tmp_path):
    (tmp_path / "h.csv").write_text(HOURLY)
    good, bad = readers.read_hourly(spark, str(tmp_path / "h.csv"))
    got = {r["bus_route"]: (str(r["transit_timestamp"]), r["ridership"]) for r in good.collect()}
    assert got == {"L7": ("2019-03-09 18:00:00", 41), "Route Unlisted": ("2019-03-09 00:00:00", 3)}
    errors = {(r["details"], r["payload"]) for r in bad.collect()}
    assert {d for d, _ in errors} == {"transit_timestamp", "ridership"}
    assert any("many" in p for _, p in errors)


def test_files_are_read_by_their_own_header(spark, tmp_path):
    for name, text in (("a", HOURLY), ("b", REORDERED)):
        (tmp_path / f"{name}.csv").write_text(text)
    good, bad = readers.read_hourly(spark, str(tmp_path / "*.csv"))
    assert {(r["bus_route"], r["payment_method"], r["ridership"]) for r in good.collect()} == {
        ("L7", "card", 41), ("Route Unlisted", "cash", 3), ("M3", "card", 12)
    }
    assert bad.count() == 2
    days = {"x": "Date,x,y\n2024-01-01,1,2\n", "y": "y,Date,x\n4,2024-01-02,3\n"}
    for name, text in days.items():
        (tmp_path / f"{name}.txt").write_text(text)
    wide, _ = readers.read_daily(spark, str(tmp_path / "*.txt"), ["x", "y"])
    assert sorted((r["x"], r["y"]) for r in wide.collect()) == [(1.0, 2.0), (3.0, 4.0)]


def test_daily_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        "Date,Subways: Total,Buses: Total Riders,Buses: % of Day\n2024-01-02,5,100,81.5\n01/03/2024,6,,82\nbad,7,1,1\n"
    )
    measures = ["Buses: Total Riders", "Buses: % of Day"]
    wide, bad = readers.read_daily(spark, str(tmp_path / "d.csv"), measures)
    assert wide.columns == ["date", "buses_total_riders", "buses_pct_of_day"]
    assert [(str(r[0]), r[1], r[2]) for r in wide.collect()] == [
        ("2024-01-02", 100.0, 81.5), ("2024-01-03", None, 82.0)
    ]
    assert [r["details"] for r in bad.collect()] == ["date"]
    assert wide.na.drop("any").count() == 1
    assert readers.daily_long(wide, wide.columns[1:]).count() == 4
    with pytest.raises(ValueError, match="Ferry"):
        readers.read_daily(spark, str(tmp_path / "d.csv"), ["Ferry"])


def test_stops_and_active_subset(spark, rows, tmp_path):
    (tmp_path / "s.csv").write_text("stop,region,lat,lng\nA,north,1.5,2.5\nB,south,3.0,4.0\n")
    stops = readers.read_stops(spark, str(tmp_path / "s.csv"), active=["B"])
    assert [r["stop"] for r in stops.filter("active").collect()] == ["B"]
    assert [r["stop"] for r in readers.active_stops(stops, rows([("A",), ("A",)], "stop string")).collect()] == ["A"]
    assert [r["stop"] for r in readers.list_stops(stops.union(stops)).collect()] == ["A", "B"]


def test_requests_and_landed_feeds(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"departure":{"lat":1,"lng":2},"timeToDestination":"14:30"}\n{"departure":\n')
    got = readers.read_requests(spark, str(tmp_path / "r.json")).collect()
    assert got[0]["departure"]["lat"] == 1.0 and got[1]["_corrupt_record"] is not None
    flows = tables.flow_snapshots(spark, SMALL).withColumn("stop_id", F.col("stop_id").cast("string"))
    flows.write.parquet(str(tmp_path / "flow"))
    assert readers.read_landed(spark, str(tmp_path / "flow"), readers.FLOW_SCHEMA).count() == flows.count()
    hazards = tables.incidents(spark, SMALL)
    hazards.write.json(str(tmp_path / "incidents"))
    assert readers.read_landed(spark, str(tmp_path / "incidents"), readers.INCIDENT_SCHEMA, "json").count() == hazards.count()


def test_forecast_sinks_round_trip(spark, rows, tmp_path):
    table = rows([("a", 1, 5), ("b", 1, 6), ("a", 2, 7)], "series_key string, step bigint, prediction bigint")
    sinks.write_forecasts(table, str(tmp_path / "f"))
    sinks.write_partitioned_forecasts(table, str(tmp_path / "p"))
    expected = sorted(map(tuple, table.collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "f")).collect())) == expected
    back = spark.read.parquet(str(tmp_path / "p")).select("series_key", "step", "prediction")
    assert sorted(map(tuple, back.collect())) == expected


def test_envelopes(rows, tmp_path, spark):
    df = rows([(7, 3, "2024-01-01 10:00:00")], "prediction bigint, horizon bigint, at timestamp_ntz")
    lines = df.select(sinks.envelope("days_future", "daily", F.col("at")).alias("line"))
    sinks.write_json_lines(lines, "line", str(tmp_path / "e"))
    assert json.loads(spark.read.text(str(tmp_path / "e")).first()[0]) == {
        "prediction": 7, "days_future": 3, "model_type": "daily", "timestamp": "2024-01-01T10:00:00"
    }
    bad = df.select(sinks.error_envelope("days_requested", "daily", F.lit("x"), F.lit("soon"), F.col("at")))
    assert json.loads(bad.first()[0])["days_requested"] == "soon"


def test_insights_and_errors_round_trip(spark, tmp_path):
    requests, stops = tables.trip_requests(spark, SMALL), tables.stops(spark, SMALL)
    no_forecast = spark.createDataFrame([], "series_key string, phase bigint, since bigint, q50 double")
    trips = trip_insight.insights(
        requests, stops, tables.flow_snapshots(spark, SMALL), tables.incidents(spark, SMALL), no_forecast
    )
    nested = trip_insight.response(trip_insight.with_other_rides(trips))
    for fmt in ("parquet", "json"):
        sinks.write_insights(nested, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == nested.count()
    lost = joins.unmatched(trip_insight.locate(requests, stops))
    errors = lost.select(F.lit("Unknown stop").alias("error"), F.col("unknown").alias("details"), F.col("dep_stop").alias("payload"))
    sinks.write_errors(errors, str(tmp_path / "errors"), "first")
    assert spark.read.json(str(tmp_path / "errors")).count() + nested.count() == requests.count()


def test_staged_plan_gives_the_same_trips(spark, tmp_path):
    def run(folder):
        trips = trip_insight.insights(
            tables.trip_requests(spark, SMALL),
            tables.stops(spark, SMALL),
            tables.flow_snapshots(spark, SMALL),
            tables.incidents(spark, SMALL),
            trip_insight.route_profile(series.hourly_series(tables.ridership(spark, SMALL), "bus_route")),
            folder=folder,
        )
        return sorted(map(str, trips.select("request_id", "travel_minutes", "density", "nudge").collect()))

    assert run(None) == run(str(tmp_path))


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.conf.get("spark.sql.warehouse.dir"))


STOPS = "stop,region,lat,lng\nOak,north,32.5,-80.5\nElm,south,32.75,-80.25\n"


def test_from_files_to_insights(spark, rows, tmp_path):
    (tmp_path / "stops.csv").write_text(STOPS)
    (tmp_path / "hours.csv").write_text(HOURLY)
    stops = readers.read_stops(spark, str(tmp_path / "stops.csv"))
    rides, _ = readers.read_hourly(spark, str(tmp_path / "hours.csv"))
    seen = [(1, "Oak", "2024-01-01 07:55:00", 30, 40), (2, "Elm", "2024-01-01 07:50:00", 20, 40)]
    rows(seen, "flow_id bigint, stop_id string, observed_at timestamp_ntz, mph bigint, free_mph bigint").write.parquet(str(tmp_path / "flow"))
    flows = readers.read_landed(spark, str(tmp_path / "flow"), readers.FLOW_SCHEMA)
    hazards = spark.createDataFrame([], readers.INCIDENT_SCHEMA)
    place = lambda a, b: '{"lat":%s,"lng":%s}' % (a, b)  # noqa: E731, UP031
    body = '{"departure":%s,"destination":%s,"timeToDestination":"%s"}'
    oak, elm = place(32.5, -80.5), place(32.75, -80.25)
    bodies = [body % (oak, elm, "18:30"), body % (oak, place(1, 1), "09:00"), body % ("{}", elm, "09:00"), body % (oak, elm, "soon")]
    asked = rows(
        [(i, "2024-01-02 08:00:00", 5, "L7", b) for i, b in enumerate(bodies)],
        "request_id bigint, requested_at timestamp_ntz, rider_id bigint, route string, body string",
    )
    accepted, errors = trip_insight.locate_bodies(asked, stops)
    profile = trip_insight.route_profile(series.hourly_series(rides, "bus_route"))
    trip = trip_insight.insights_of(accepted, flows, hazards, profile).collect()
    assert [(r["request_id"], r["route"], r["predicted_riders"], r["dep_mph"], r["dst_mph"]) for r in trip] == [(0, "L7", 41, 30, 20)]
    assert {r["request_id"]: (r["error"], r["details"]) for r in errors.collect()} == {
        1: ("Unknown stop", "destination"),
        2: ("Missing required fields", "departure"),
        3: ("Missing required fields", "timeToDestination"),
    }


def test_a_run_that_is_repeated_leaves_one_copy(spark, rows, tmp_path):
    path = str(tmp_path / "errors")
    some = rows([("bad", "a", "{"), ("bad", "b", "}")], "error string, details string, payload string")
    sinks.write_errors(some, path, "2024-01-01 00:00/1")
    sinks.write_errors(some, path, "other")
    sinks.write_errors(some.limit(1), path, "2024-01-01 00:00/1")
    kept = spark.read.json(path)
    assert sorted((r["run"], r["n"]) for r in kept.groupBy("run").agg(F.count("*").alias("n")).collect()) == [("2024-01-01 00:00/1", 1), ("other", 2)]
    table = rows([("a", 1, 2), ("b", 1, 3)], "series_key string, step bigint, prediction bigint")
    for _ in range(2):
        sinks.write_run(table, str(tmp_path / "forecasts"), "r", by=["series_key"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "forecasts")).select("run", "series_key", "prediction").collect()) == [("r", "a", 2), ("r", "b", 3)]
