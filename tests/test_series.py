from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from commutelens.operators import series

SERIES = "series_key string, slot bigint, y bigint"


def test_hours_are_summed_per_key(rows):
    df = rows(
        [("R1", "2024-01-01 05:10:00", 3), ("R1", "2024-01-01 05:59:59", 4), ("NIS", "2024-01-01 05:00:00", 1)],
        "bus_route string, transit_timestamp timestamp_ntz, ridership bigint",
    )
    got = {(r["series_key"], r["y"]) for r in series.hourly_series(df, "bus_route").collect()}
    assert got == {("R1", 7), ("NIS", 1)}


def test_missing_column_is_named(rows):
    with pytest.raises(ValueError, match="ridership"):
        series.hourly_series(rows([("a", "2024-01-01 00:00:00")], "k string, transit_timestamp timestamp_ntz"), "k")


def test_target_discovery(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Date", "Buses: Total Estimated Ridership", "Subways total"])
    assert series.find_target(df) == "Buses: Total Estimated Ridership"
    assert series.find_target(df.select("Date")) is None


def test_gap_fill_covers_the_span(rows):
    filled = series.fill_gaps(rows([("a", 1, 10), ("a", 4, 40), ("b", 7, 1)], SERIES))
    got = sorted((r["series_key"], r["slot"], r["y"]) for r in filled.collect())
    assert got == [("a", 1, 10), ("a", 2, None), ("a", 3, None), ("a", 4, 40), ("b", 7, 1)]
    ffill = sorted((r["series_key"], r["slot"], r["y_filled"]) for r in series.forward_fill(filled).collect())
    assert [v for _, _, v in ffill] == [10, 10, 10, 40, 1]


def test_mean_change_telescopes(rows):
    rng = random.Random(2)
    data = [(k, i, rng.randrange(100)) for k in "ab" for i in range(20)] + [("single", 3, 5)]
    df = rows(data, SERIES)
    drift = {r["series_key"]: r["drift"] for r in series.mean_change(df).collect()}
    long_form = series.first_difference(df).groupBy("series_key").agg(F.avg("diff").alias("d"))
    for r in long_form.collect():
        assert drift[r["series_key"]] == (pytest.approx(r["d"]) if r["d"] is not None else None)


def test_extrapolation_is_cumulative(rows):
    got = series.extrapolate(rows([("a", 1, 10), ("a", 2, 12), ("a", 3, 16), ("one", 5, 7)], SERIES), 3)
    values = {(r["series_key"], r["step"]): (r["slot"], r["y"]) for r in got.collect()}
    assert values["a", 1] == (4, 19.0) and values["a", 3] == (6, 25.0)
    assert values["one", 2] == (7, 7.0)


def test_coverage_of_an_empty_series(rows):
    keys = rows([("a",), ("none",)], "series_key string")
    got = {r["series_key"]: r.asDict() for r in series.coverage(keys, rows([("a", 1, 1), ("a", 5, 1)], SERIES)).collect()}
    assert got["a"]["missing_slots"] == 3 and not got["a"]["needs_fallback"]
    assert got["none"]["n_slots"] == 0 and got["none"]["needs_fallback"]


def test_cube_expands_only_the_reduced_rows(rows):
    df = rows([("x", "p", 1), ("x", "q", 2), ("y", "p", 4)] * 5, "a string, b string, n bigint")
    cube = series.breakdown(df, ["a", "b"], ["n"])
    total = [r["n"] for r in cube.collect() if r["grouping_level"] == 3]
    assert total == [35] and cube.count() == 3 + 2 + 2 + 1
    plan = cube._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # an aggregate lies below the expand


def test_stitch_orders_across_blocks(rows):
    data = [(1, i, f"<{i}>") for i in range(20)] + [(2, 5, "only")]
    random.Random(1).shuffle(data)
    got = {r["c"]: (r["text"], r["n_chunks"]) for r in series.stitch(rows(data, "c bigint, s bigint, t string"), "c", "s", "t", 3).collect()}
    assert got == {1: ("".join(f"<{i}>" for i in range(20)), 20), 2: ("only", 1)}


def test_last_known_follows_time_not_row_order(rows):
    got = series.last_known(rows([("a", 9, 1), ("a", 2, 5)], SERIES)).first()
    assert (got["slot"], got["y"]) == (9, 1)
