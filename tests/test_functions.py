from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from commutelens.functions import clock, geo, jsons, money, numeric, wording


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_12_hour_text(rows):
    df = rows(
        [("01/31/2024 12:00:00 AM",), ("01/31/2024 12:30:00 PM",), ("01/31/2024 08:00:00 PM",), ("31/01/2024",), (None,)],
        "t string",
    )
    got = [r[0] for r in values(df, clock.parse_ampm(F.col("t")))]
    assert got == [datetime(2024, 1, 31), datetime(2024, 1, 31, 12, 30), datetime(2024, 1, 31, 20), None, None]


@pytest.mark.parametrize(
    ("now", "text", "arrival", "hours"),
    [
        ("2024-01-10 08:15:00", "08:15", datetime(2024, 1, 11, 8, 15), 24),  # equal rolls forward
        ("2024-01-10 08:15:00", "08:16", datetime(2024, 1, 10, 8, 16), 0),
        ("2024-01-10 08:15:30", "08:15", datetime(2024, 1, 11, 8, 15), 23),
        ("2024-01-10 23:30:00", "00:00", datetime(2024, 1, 11), 0),
        ("2024-02-28 10:00:00", "09:00", datetime(2024, 2, 29, 9), 23),
        ("2024-03-10 01:30:00", "03:30", datetime(2024, 3, 10, 3, 30), 2),
        ("2024-01-10 08:00:00", "25:00", None, None),
        ("2024-01-10 08:00:00", "noon", None, None),
        ("2024-01-10 08:00:00", "9", None, None),
    ],
)
def test_arrival(rows, now, text, arrival, hours):
    df = rows([(now, text)], "now timestamp_ntz, text string").withColumn(
        "arrival", clock.resolve_arrival(F.col("now"), F.col("text"))
    )
    got = values(df, "arrival", clock.hours_between(F.col("now"), F.col("arrival")))[0]
    assert got == (arrival, hours)


def test_slots_round_trip(rows):
    df = rows([("1969-12-31 23:59:00",), ("2024-02-29 05:45:10",)], "ts timestamp_ntz")
    got = values(df, clock.hour_of_slot(clock.hour_slot(F.col("ts"))), clock.hour_floor(F.col("ts")))
    assert got == [(datetime(1969, 12, 31, 23),) * 2, (datetime(2024, 2, 29, 5),) * 2]


def test_iso_text_in_a_zone(rows):
    df = rows([("2024-07-01 10:00:00",)], "ts timestamp_ntz")
    assert values(df, clock.iso_utc(F.col("ts"), "America/New_York"), clock.iso_utc(F.col("ts"))) == [
        ("2024-07-01T14:00:00.000Z", "2024-07-01T10:00:00.000Z")
    ]


def test_rounding_rules(rows):
    df = rows([(-2.7,), (-2.5,), (2.5,), (0.49,)], "x double")
    x = F.col("x")
    got = values(df, numeric.toward_zero(x), numeric.downward(x), numeric.round_half_up(x))
    assert got == [(-2, -3, -3), (-2, -3, -2), (2, 2, 3), (0, 0, 0)]


def test_number_in_any_shape(rows):
    texts = ["7", '{"prediction": 8.5}', "[9, 1]", "[]", '{"error": 1}', '{"prediction": "x"}', "{", None]
    df = rows([(t,) for t in texts], "t string")
    assert [r[0] for r in values(df, jsons.unwrap_number(F.col("t")))] == [7.0, 8.5, 9.0, None, None, None, None, None]


def test_absent_keys_look_at_presence(rows):
    df = rows([('{"a": null}',), ("{}",), ("[1]",), ("{",), (None,)], "t string")
    got = [r[0] for r in values(df, jsons.absent_keys(F.col("t"), ("a", "b")))]
    assert got == [["b"], ["a", "b"], None, None, None]


def test_distance_and_box(rows):
    df = rows([(32.0, -80.0, 32.0, -80.0), (0.0, 0.0, 0.0, 1.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    a, b, c, d = (F.col(x) for x in "abcd")
    miles = [r[0] for r in values(df, geo.great_circle_miles(a, b, c, d))]
    assert miles[0] == 0.0 and abs(miles[1] - 69.0934) < 0.001 and miles[2] is None
    box = geo.bounding_box(a, b, c, d)
    assert values(df, *box.values())[1:] == [(0.0, 0.0, 0.0, 1.0), (None, None, None, None)]


def test_incentive_ignores_case(rows):
    df = rows([("light",), ("MEDIUM",), ("Heavy",), ("Normal",), (None,)], "d string")
    assert [r[0] for r in values(df, money.incentive_usd(F.col("d")))] == [1, 2, 4, None, None]


def test_money_text_and_savings(rows):
    df = rows([(0.0,), (20.0,), (100.0,), (None,)], "miles double")
    saved = money.trip_savings_cents(F.col("miles"))
    got = values(df, saved, money.dollars_text(saved))
    assert got == [(0, "0.00"), (80, "0.80"), (1200, "12.00"), (None, None)]


def test_clock_pattern(rows):
    texts = ["1:05 pm", "12:59AM", "01:00 PM", "13:00 PM", "0:10 am", "1:60 pm", "1:05  pm", "1:05", None]
    df = rows([(t,) for t in texts], "t string")
    assert [r[0] for r in values(df, wording.is_clock12(F.col("t")))] == [True, True, True] + [False] * 6


def test_percent_in_text(rows):
    df = rows([("100%",), ("about 30% (less)",), ("Higher (100%)",), ("none",)], "t string")
    assert [r[0] for r in values(df, wording.percent_in(F.col("t")))] == [100, 30, 100, None]


def test_message_leaves_out_what_is_unknown(rows):
    df = rows([(12, "Light", 80, 41.5), (12, "Heavy", 0, None), (None, None, 80, 3.0)], "m bigint, d string, s bigint, r double")
    got = [r[0] for r in values(df, wording.nudge(F.col("m"), F.col("d"), F.col("s"), F.col("r")))]
    assert got[0].endswith("keeps $0.80 in your pocket. Around 42 riders are expected.")
    assert got[1] == "Traffic on this route is heavy; the bus needs about 12 min."
    assert got[2] is None


def test_display_stand_in(rows):
    df = rows([(5,), (None,)], "m bigint")
    assert [r[0] for r in values(df, wording.shown(F.col("m"), suffix=" mins"))] == ["5 mins", "N/A"]


def test_hours_ahead_stay_within_a_day(spark):
    from commutelens.operators import insight
    from commutelens.sources import tables
    from conftest import SMALL

    resolved = insight.with_arrival(tables.trip_requests(spark, SMALL))
    low, high, long = resolved.agg(F.min("hours_ahead"), F.max("hours_ahead"), F.max("long_horizon")).first()
    assert 0 <= low and high <= 24 and long is False
    assert resolved.filter(F.col("arrival_at") <= F.col("requested_at")).count() == 0
