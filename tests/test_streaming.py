from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from catalog.queries import QUERIES
from commutelens.operators import joins
from commutelens.plans import trip_insight
from commutelens.sources import tables
from commutelens.streaming import jobs
from conftest import SMALL

SCHEMA = "k string, ts timestamp_ntz, n bigint"


def test_new_files_continue_from_the_checkpoint(spark, rows, tmp_path):
    landing, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))

    def land(*data):
        rows(list(data), SCHEMA).coalesce(1).write.mode("append").parquet(landing)

    def run():
        stream = jobs.hourly_totals(jobs.history_stream(spark, landing, SCHEMA), "k", "ts", "n")
        jobs.append_to(stream, out, check).awaitTermination()
        return sorted((r["series_key"], str(r["hour"]), r["y"]) for r in spark.read.parquet(out).collect())

    land(("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 00:50:00", 2), ("a", "2024-01-01 02:30:00", 4))
    assert run() == [("a", "2024-01-01 00:00:00", 3)]
    land(("a", "2024-01-01 00:20:00", 100), ("a", "2024-01-01 02:40:00", 8), ("a", "2024-01-01 05:00:00", 1))
    # The first hour is closed, so its late row is dropped; the third hour sums over both files.
    assert run() == [("a", "2024-01-01 00:00:00", 3), ("a", "2024-01-01 02:00:00", 12)]


def test_stream_gives_every_hour_of_the_batch(spark):
    streamed = QUERIES["stream_hourly"](spark, SMALL).collect()
    batch = {(r["series_key"], r["ts"]): r["y"] for r in QUERIES["hourly_ridership"](spark, SMALL).collect()}
    assert {(r["series_key"], r["hour"]): r["y"] for r in streamed} == batch and len(streamed) == len(batch)
    open_hours = {r["hour"] for r in streamed if not r["closed"]}
    assert 1 <= len(open_hours) <= 2 and max(h for _, h in batch) in open_hours


def test_resends_are_dropped(spark, rows, tmp_path):
    landing = str(tmp_path / "in")
    rows([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:02"), (2, "2024-01-01 00:10:00")], "id bigint, ts timestamp_ntz").coalesce(1).write.parquet(landing)
    stream = jobs.without_resends(jobs.history_stream(spark, landing, "id bigint, ts timestamp_ntz"), "id", "ts")
    jobs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_csv_history_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.csv").write_text("k,ts,n\na,2024-01-01 00:10:00,1\n")
    stream = jobs.history_stream(spark, str(landing), SCHEMA, "csv", files_per_batch=1)
    jobs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["n"] == 1


def test_batch_plan_per_micro_batch_covers_every_request(spark, tmp_path):
    landing = str(tmp_path / "in")
    tables.table(spark, SMALL, "events").repartition(3).write.parquet(landing)
    stream = jobs.history_stream(spark, landing, tables.SCHEMAS["events"], files_per_batch=1)

    def transform(batch):
        asked = tables.requests_of(batch, tables.table(spark, SMALL, "supplier"))
        even = F.col("request_id") % 2 == 0
        rejected = asked.filter(~even).select(F.lit("odd").alias("error"), F.lit("").alias("details"), F.col("arrive_by").alias("payload"))
        return asked.filter(even), rejected

    jobs.per_batch(stream, transform, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    ok, bad = spark.read.parquet(str(tmp_path / "ok")), spark.read.json(str(tmp_path / "bad"))
    assert ok.select("batch_id").distinct().count() == 3
    assert ok.count() + bad.count() == tables.trip_requests(spark, SMALL).count()



def in_unsorted_files(spark, folder, n):
    """The small tables, with events dealt over n files that each span the whole time, the late rows first."""
    folder.mkdir()
    for table in Path(SMALL).glob("*.parquet"):
        if table.stem != "events":
            (folder / table.name).symlink_to(table)
    events = tables.table(spark, SMALL, "events")
    events.repartition(n, "event_id").sortWithinPartitions(F.desc("ts")).write.parquet(f"{folder}/events.parquet")
    assert len(list((folder / "events.parquet").glob("part-*"))) == n
    return str(folder)


def test_requests_in_unsorted_files_all_come_out(spark, tmp_path):
    folder = in_unsorted_files(spark, tmp_path / "in", 6)
    unique = [r["request_id"] for r in QUERIES["stream_unique_requests"](spark, folder).collect()]
    ids = [r["event_id"] for r in tables.table(spark, SMALL, "events").collect()]
    assert sorted(unique) == sorted(ids)
    insights = [r["request_id"] for r in QUERIES["stream_trip_insights"](spark, folder).collect()]
    assert sorted(insights) == sorted(r["request_id"] for r in tables.trip_requests(spark, SMALL).collect())


def sums(spark, landing, tmp_path, **how):
    stream = jobs.history_stream(spark, landing, SCHEMA, **how)
    jobs.sums_by_batch(stream, "k", "ts", "n", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = jobs.hours_so_far(spark, str(tmp_path / "out")).collect()
    return {(r["series_key"], str(r["hour"])[11:16]): (r["y"], r["closed"], r["corrected"]) for r in got}


def test_late_rows_correct_hours_that_were_closed(spark, rows, tmp_path):
    landing = str(tmp_path / "in")

    def land(*data):
        rows(list(data), SCHEMA).coalesce(1).write.mode("append").parquet(landing)

    land(("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 00:50:00", 2), ("a", "2024-01-01 02:30:00", 4), ("a", None, 9))
    assert sums(spark, landing, tmp_path) == {("a", "00:00"): (3, True, False), ("a", "02:00"): (4, False, False)}
    land(("a", "2024-01-01 00:20:00", 100), ("a", "2024-01-01 02:40:00", 8), ("b", "2024-01-01 05:00:00", 1), (None, "2024-01-01 05:00:00", 7))
    second = {
        ("a", "00:00"): (103, True, True), ("a", "02:00"): (12, True, False), ("b", "05:00"): (1, False, False), (None, "05:00"): (7, False, False),
    }
    assert sums(spark, landing, tmp_path) == second
    # Nothing new, and the last batch once more after a lost commit: one copy.
    assert sums(spark, landing, tmp_path) == second
    (tmp_path / "check" / "commits" / "1").unlink()
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert sums(spark, landing, tmp_path) == second


def test_hours_are_what_the_stream_wrote(spark, rows, tmp_path):
    landing = str(tmp_path / "in")
    rows([("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 05:00:00", 1)], SCHEMA).write.parquet(landing)
    sums(spark, landing, tmp_path)
    wrong = rows([("a", "2024-01-01 00:00:00", 999, "2024-01-01 00:10:00")], "series_key string, hour timestamp_ntz, y bigint, latest timestamp_ntz")
    wrong.write.mode("overwrite").parquet(str(tmp_path / "out" / "batch_id=0"))
    assert sums(spark, landing, tmp_path) == {("a", "00:00"): (999, False, False)}


def test_hours_are_whole_when_files_come_out_of_order(spark, tmp_path):
    folder = in_unsorted_files(spark, tmp_path / "in", 6)
    stream = jobs.history_stream(spark, f"{folder}/events.parquet", tables.SCHEMAS["events"], files_per_batch=1)
    rides = stream.withColumn("ridership", F.floor("value").cast("bigint"))
    jobs.sums_by_batch(rides, "event_type", "ts", "ridership", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = jobs.hours_so_far(spark, str(tmp_path / "out")).collect()
    want = {(r["series_key"], r["ts"]): r["y"] for r in QUERIES["hourly_ridership"](spark, SMALL).collect()}
    assert {(r["series_key"], r["hour"]): r["y"] for r in got} == want and len(got) == len(want)
    assert any(r["corrected"] for r in got) and {r["closed"] for r in got} == {True, False}


def test_stream_takes_a_history_of_many_files_as_one_batch(spark, rows, tmp_path):
    landing = str(tmp_path / "in")
    data = [("a", f"2024-01-{1 + i % 20:02d} 00:10:00", 1) for i in range(600)]
    rows(data, SCHEMA).repartition(600).write.option("maxRecordsPerFile", 1).parquet(landing)
    totals = jobs.hourly_totals(jobs.history_stream(spark, landing, SCHEMA), "k", "ts", "n")
    jobs.append_to(totals, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["y"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [30] * 19


def test_trips_answered_in_parts_by_time(spark, rows, tmp_path):
    """Parts see only what is known within their time, and answer like one go over everything."""
    draw = random.Random(5)
    at = lambda: f"2024-03-{draw.randrange(1, 4):02d} {draw.randrange(24):02d}:{draw.randrange(60):02d}:{draw.randrange(60):02d}"
    stops = rows([(i, f"s{i}", 32.6 + i * 0.01, -80.2 + i * 0.013) for i in range(9)], "stop_id bigint, stop string, lat double, lng double")
    asked = [(i, at() if i % 10 else None, i, f"R{i % 3}", f"s{draw.randrange(9)}", f"s{draw.randrange(9)}", f"{draw.randrange(24):02d}:15") for i in range(60)]
    asked += [(100 + i, "2024-03-02 12:00:00", i, "R1", "s1", "s8", "18:00") for i in range(10)]
    asked = rows(asked, "request_id bigint, requested_at timestamp_ntz, rider_id bigint, route string, dep_stop string, dst_stop string, arrive_by string")
    flows = rows([(i, draw.randrange(9), at(), draw.randrange(5, 41), 40) for i in range(200)], "flow_id bigint, stop_id bigint, observed_at timestamp_ntz, mph bigint, free_mph bigint")
    incidents = rows(
        [(32.6 + draw.random() / 10, -80.2 + draw.random() / 10, draw.randrange(4), at(), None if i % 9 == 0 else "2024-03-03 06:00:00") for i in range(300)],
        "lat double, lng double, icon_category bigint, valid_from timestamp_ntz, valid_to timestamp_ntz",
    )
    profile = rows([(f"R{r}", h, 475000 + d * 24, 1.0 * (r + h + d)) for r in range(3) for h in range(24) for d in range(3)], "series_key string, phase int, since bigint, q50 double")
    trips = joins.matched(trip_insight.locate(asked, stops))
    names = ["request_id", "incidents", "dep_mph", "dst_mph", "predicted_riders", "travel_minutes", "density", "savings_cents", "nudge"]
    whole = trip_insight.insights_of(trips, flows, incidents, profile).select(*names)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    answer = lambda df: sorted(map(repr, df.collect()))
    want = answer(whole)
    got = trip_insight.insights_in_parts(trips, flows, incidents, profile, names, str(tmp_path / "parts"), at_once=30)
    assert answer(got) == want and 2 <= len(list((tmp_path / "parts").iterdir())) <= 3
    assert len(want) == 70 and spark.conf.get(key, None) == before
