"""Joins and ordered neighbours against brute force, and their plans."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from commutelens.functions import clock
from commutelens.operators import boxsums, joins, rides
from commutelens.plans import trip_insight
from commutelens.params import GridParams, NearGridParams, SumGridParams

START = datetime(2024, 1, 1)


def moment(rng, days=3):
    return str(START + timedelta(seconds=rng.randrange(days * 86400)))


@pytest.mark.parametrize("bucket_minutes", [5, 60, 100_000])
def test_as_of_equals_brute_force_with_a_hot_key(rows, bucket_minutes):
    rng = random.Random(1)
    keys = lambda: 0 if rng.random() < 0.5 else rng.randrange(1, 6)
    facts = [(i, keys(), moment(rng), rng.randrange(50)) for i in range(300)]
    facts += [(1000, 0, facts[0][2], 99), (1001, 0, facts[0][2], 77)]  # equal times: the larger id wins
    probes = [(i, keys(), moment(rng)) for i in range(300)] + [(900, 0, facts[0][2]), (901, 77, moment(rng))]
    f = rows(facts, "fid bigint, k bigint, at timestamp_ntz, v bigint")
    p = rows(probes, "pid bigint, k bigint, asked timestamp_ntz")
    got = joins.as_of(p, f, "k", "asked", "at", "fid", ["v"], bucket_minutes)
    result = {r["pid"]: r["v"] for r in got.collect()}

    def expected(key, asked):
        seen = [(at, fid, v) for fid, k, at, v in facts if k == key and at <= asked]
        return max(seen)[2] if seen else None

    assert result == {pid: expected(k, asked) for pid, k, asked in probes}
    assert got.count() == len(probes)


def test_as_of_keeps_probes_without_facts(rows):
    f = rows([], "fid bigint, k bigint, at timestamp_ntz, v bigint")
    p = rows([(1, 1, "2024-01-01 00:00:00")], "pid bigint, k bigint, asked timestamp_ntz")
    assert [r["v"] for r in joins.as_of(p, f, "k", "asked", "at", "fid", ["v"]).collect()] == [None]


def incident_case(rows, rng, n=150):
    boxes, points = [], []
    for i in range(n):
        size = rng.choice([0.0, 0.01, 0.2, 3.0, 20.0])
        south, west = rng.uniform(-5, 5), rng.uniform(-5, 5)
        boxes.append((i, moment(rng), south, west, south + size, west + size * rng.random()))
    for i in range(n):
        begin = START + timedelta(seconds=rng.randrange(3 * 86400))
        length = rng.choice([0, 60, 7200, 86400, 40 * 86400])
        points.append((i, rng.uniform(-5, 5), rng.uniform(-5, 5), str(begin), str(begin + timedelta(seconds=length))))
    points.append((n, boxes[0][2], boxes[0][3], boxes[0][1], str(START + timedelta(days=9))))  # corner, first moment
    points.append((n + 1, 0.05, 0.1, "2024-01-01 00:00:00", "2024-02-01 00:00:00"))  # on cell edges
    boxes.append((n, "2024-01-02 00:00:00", 0.05, 0.1, 0.05, 0.1))
    b = rows(boxes, "bid bigint, asked timestamp_ntz, south double, west double, north double, east double")
    p = rows(points, "pid bigint, lat double, lng double, since timestamp_ntz, until timestamp_ntz")
    truth = sorted(
        (b_[0], p_[0])
        for b_ in boxes
        for p_ in points
        if b_[2] <= p_[1] <= b_[4] and b_[3] <= p_[2] <= b_[5] and p_[3] <= b_[1] < p_[4]
    )
    return b, p, truth


@pytest.mark.parametrize("grid", [GridParams(), GridParams(base_degrees=0.5, levels=2, time_rungs_minutes=(30, 600))])
def test_box_join_equals_brute_force(rows, grid):
    b, p, truth = incident_case(rows, random.Random(7))
    got = joins.boxes_with_points(b, p, "asked", "since", "until", grid)
    assert sorted((r["bid"], r["pid"]) for r in got.collect()) == truth
    assert len(truth) > 50


def test_box_join_is_an_equi_join(spark, rows):
    b, p, _ = incident_case(rows, random.Random(3), 10)
    joined = joins.boxes_with_points(b, p.hint("merge"), "asked", "since", "until")
    plan = plan_of(joined)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SortMergeJoin" in plan


def test_boxes_without_coordinates_match_nothing(rows):
    b = rows([(1, "2024-01-01 00:00:00", None, None, None, None)], "bid bigint, asked timestamp_ntz, south double, west double, north double, east double")
    p = rows([(1, 0.0, 0.0, "2023-01-01 00:00:00", "2025-01-01 00:00:00")], "pid bigint, lat double, lng double, since timestamp_ntz, until timestamp_ntz")
    assert joins.boxes_with_points(b, p, "asked", "since", "until").count() == 0


@pytest.mark.parametrize("grid", [SumGridParams(), SumGridParams(0.3, 3, 5), SumGridParams(2.0, 1, 100_000)])
def test_box_totals_equal_brute_force(rows, grid):
    b, p, truth = incident_case(rows, random.Random(11))
    got = boxsums.totals_in_boxes(b, p.withColumns({"one": F.lit(1), "id": F.col("pid") - 40}), "bid", "asked", "since", "until", ["one", "id"], grid)
    want = {}
    for box, point in truth:
        n, total = want.get(box, (0, 0))
        want[box] = (n + 1, total + point - 40)
    assert {r["bid"]: (r["one"], r["id"]) for r in got.collect()} == {i: v for i, v in want.items() if v != (0, 0)}


def test_box_totals_without_coordinates_moments_and_points(rows):
    b = rows(
        [(1, "2024-01-01 00:00:00", None, 0.0, 1.0, 1.0), (2, None, 0.0, 0.0, 1.0, 1.0), (3, "2024-01-01 00:00:00", 0.0, 0.0, 1.0, 1.0)],
        "bid bigint, asked timestamp_ntz, south double, west double, north double, east double",
    )
    schema = "lat double, lng double, since timestamp_ntz, until timestamp_ntz, n bigint"
    data = [(0.5, 0.5, "2023-01-01 00:00:00", None, 2), (0.5, 0.5, None, None, 7), (None, 0.5, "2023-01-01 00:00:00", None, 9), (0.5, 0.5, "2024-01-01 00:00:00", "2024-01-01 00:00:00", 5)]
    total = lambda points: boxsums.totals_in_boxes(b, rows(points, schema), "bid", "asked", "since", "until", ["n"]).collect()
    assert [tuple(r) for r in total(data)] == [(3, 2)]
    assert total([]) == []


def test_listed_rows_of_boxes_and_points_are_not_broadcast(rows):
    """Each row lists many, so what looks small in an estimate need not fit the driver."""
    b, p, _ = incident_case(rows, random.Random(3), 10)
    plan = plan_of(boxsums.totals_in_boxes(b, p.withColumn("n", F.lit(1)), "bid", "asked", "since", "until", ["n"]))
    assert "BroadcastExchange" not in plan and "ShuffledHashJoin" in plan


def test_inner_rectangles_of_a_box_make_no_pairs(rows, monkeypatch):
    """Boxes and points that all meet: pairs are made along the edges only."""
    made = []
    monkeypatch.setattr(joins, "is_inside", lambda *names: F.lit(True))
    b = rows([(i, "2024-01-02 00:00:00", 0.01, 0.01, 1.59, 1.59) for i in range(40)], "bid bigint, asked timestamp_ntz, south double, west double, north double, east double")
    p = rows([(0.03 + 0.01 * (i % 150), 0.03 + 0.01 * (i // 2), "2024-01-01 00:00:00", "2024-01-03 00:00:00", 1) for i in range(300)], "lat double, lng double, since timestamp_ntz, until timestamp_ntz, n bigint")
    union = type(b).unionByName
    monkeypatch.setattr(type(b), "unionByName", lambda self, other, **k: made.append(other) or union(self, other, **k))
    got = boxsums.totals_in_boxes(b, p, "bid", "asked", "since", "until", ["n"]).collect()
    pairs = made[-1].count()
    assert len(got) == 40 and all(r["n"] == 300 for r in got) and pairs < 40 * 300 / 5


def test_a_box_has_few_rows_along_its_edges(rows, monkeypatch):
    """Strips are split into runs over their whole length: 64 cells are 8 runs of 8, and not outer cells and 12 runs."""
    met = []
    b = rows(
        [(1, "2024-01-02 00:00:00", 0.01, 0.01, 1.59, 1.59), (2, "2024-01-02 00:00:00", 0.01, 0.01, 0.012, 1.59), (3, "2024-01-02 00:00:00", 0.01, 0.01, 0.012, 0.012)],
        "bid bigint, asked timestamp_ntz, south double, west double, north double, east double",
    )
    p = rows([(0.011, 0.01 * i, "2024-01-01 00:00:00", "2024-01-03 00:00:00", 1) for i in range(300)], "lat double, lng double, since timestamp_ntz, until timestamp_ntz, n bigint")
    join = type(b).join
    monkeypatch.setattr(type(b), "join", lambda self, *a: met.append(self) or join(self, *a))
    got = boxsums.totals_in_boxes(b, p, "bid", "asked", "since", "until", ["n"]).collect()
    assert {r["bid"]: r["n"] for r in got} == {1: 159, 2: 159, 3: 1}
    listed = met[-1].groupBy("bid").count().collect()
    assert {r["bid"]: r["count"] for r in listed} == {1: 40, 2: 14, 3: 1}


@pytest.mark.parametrize("ranges", [1, 7, 40])
@pytest.mark.parametrize("spread", ["dense", "sparse", "hashed"])
def test_following_equals_brute_force_in_a_hot_group(rows, ranges, spread):
    rng = random.Random(5)
    ids = {"dense": range(200), "sparse": range(-(10**9), 10**9, 10**7), "hashed": [rng.randrange(-(2**63), 2**63) for _ in range(200)]}
    data = [(i, None if rng.random() < 0.1 else 1 if rng.random() < 0.6 else rng.randrange(5), rng.choice([None, 1, 2, 3, 4, 5]), f"n{i}") for i in ids[spread]]
    got = rides.following(rows(data, "id bigint, g bigint, o bigint, name string"), ["g"], "o", "id", ["name"], 3, ranges)
    result = {r["id"]: [(x["id"], x["name"]) for x in r["next_rides"]] for r in got.collect()}
    place = lambda o, i: (o is not None, o or 0, i)
    for i, g, o, _ in data:
        later = sorted(place(o2, i2) for i2, g2, o2, _ in data if g2 == g and place(o2, i2) > place(o, i))
        assert result[i] == [(i2, f"n{i2}") for _, _, i2 in later[:3]]
    assert len(result) == len(data)


def test_following_evaluates_its_input_once(rows):
    runs = rows([], "x int").sparkSession.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(x):
        runs.add(1)
        return x

    data = rows([(i, 1, i % 5) for i in range(100)], "id bigint, g bigint, o bigint").select("id", "g", seen.asNondeterministic()("o").alias("o"))
    assert rides.following(data.repartition(1), ["g"], "o", "id", [], 2, 4).count() == 100
    assert runs.value <= 200  # the range partitioning's sample and the write


def test_open_ended_points_are_found(rows):
    boxes = rows([(1, "2024-05-01 10:00:00", 0.0, 0.0, 1.0, 1.0)], "id bigint, asked timestamp_ntz, south double, west double, north double, east double")
    data = [
        (1, 0.5, 0.5, "2023-01-01 00:00:00", None),
        (2, 0.5, 0.5, "2023-01-01 00:00:00", "9999-01-01 00:00:00"),
        (3, 0.5, 0.5, "2024-06-01 00:00:00", None),
        (4, 0.5, 0.5, "2024-05-01 09:00:00", "2024-05-01 11:00:00"),
        (5, 2.0, 0.5, "2023-01-01 00:00:00", None),
    ]
    points = rows(data, "p bigint, lat double, lng double, since timestamp_ntz, until timestamp_ntz")
    got = joins.boxes_with_points(boxes, points, "asked", "since", "until").collect()
    assert sorted(r["p"] for r in got) == [1, 2, 4]


def test_all_probes_in_one_hour_of_one_stop(rows):
    rng = random.Random(4)
    moment = lambda: f"2024-05-01 10:{rng.randrange(60):02d}:{rng.randrange(60):02d}"
    facts = [(i, 1, moment(), i) for i in range(50)] + [(99, 1, "2024-04-01 00:00:00", 99)]
    probes = [(i, 1, moment()) for i in range(300)] + [(400, 1, "2024-05-01 10:00:00"), (401, 2, moment())]
    f = rows(facts, "fid bigint, stop bigint, seen timestamp_ntz, v bigint")
    p = rows(probes, "id bigint, stop bigint, asked timestamp_ntz")
    got = {r["id"]: r["v"] for r in joins.as_of(p, f, "stop", "asked", "seen", "fid", ["v"]).collect()}
    for i, stop, asked in probes:
        known = [(t, fid, v) for fid, s, t, v in facts if s == stop and t <= asked]
        assert got[i] == (max(known)[2] if known else None)


def test_first_k_limits_before_the_shuffle(rows):
    df = rows([(i, i % 2, i % 7) for i in range(50)], "id bigint, g bigint, o bigint")
    top = rides.first_k(df, ["g"], ["o", "id"], 3)
    assert "WindowGroupLimit" in plan_of(top)
    assert top.count() == 6


def test_lookup_splits_the_input(rows):
    stops = rows([("a", 1, 1.0, 2.0), ("b", 2, 3.0, 4.0)], "stop string, stop_id bigint, lat double, lng double")
    asked = rows([(1, "a", "b"), (2, "a", "x"), (3, "x", "y"), (4, None, "a"), (5, "a", "a")], "id bigint, dep_stop string, dst_stop string")
    located = joins.endpoints(asked, stops)
    good = {r["id"] for r in joins.matched(located).collect()}
    bad = {r["id"]: r["unknown"] for r in joins.unmatched(located).collect()}
    assert good == {1, 5}
    assert bad == {2: "destination", 3: "departure,destination", 4: "departure"}
    assert located.filter(F.col("id") == 5).first()["dep_lat"] == 1.0


def test_lookup_by_place_takes_one_stop(rows):
    stops = rows([("b", 2, 1.0, 2.0), ("a", 1, 1.0, 2.0), ("c", 3, 5.0, 6.0)], "stop string, stop_id bigint, lat double, lng double")
    asked = rows([(1, 1.0, 2.0, 5.0, 6.0), (2, 1.0, 2.0, 9.0, 9.0)], "id bigint, dep_lat double, dep_lng double, dst_lat double, dst_lng double")
    got = {r["id"]: (r["dep_stop"], r["dst_stop"]) for r in joins.endpoints_by_place(asked, stops).collect()}
    assert got == {1: ("a", "c"), 2: ("a", None)}


def test_feed_text_reaches_the_box_join(rows):
    feed = '{"incidents":[{"type":"Feature","geometry":{"type":"Point","coordinates":[2.5,1.5]},"properties":{"iconCategory":7}}]}'
    feeds = rows([(feed, "2024-05-01 00:00:00", None), ('{"incidents":[]}', "2024-05-01 00:00:00", None), ("{", "2024-05-01 00:00:00", None)], "feed string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    trips = rows([(1, "2024-05-02 00:00:00", 1.0, 2.0, 2.0, 3.0)], "request_id bigint, requested_at timestamp_ntz, dep_lat double, dep_lng double, dst_lat double, dst_lng double")
    got = trip_insight.incident_categories(trips, trip_insight.feed_incidents(feeds)).collect()
    assert [tuple(r) for r in got] == [(1, 7, 1)]


@pytest.mark.parametrize("grid", [NearGridParams(), NearGridParams(3.0, 8), NearGridParams(0.001, 20)])
def test_nearest_place_equals_brute_force(rows, grid):
    rng = random.Random(2)
    spot = lambda: (rng.uniform(-80, 80), rng.uniform(-170, 170)) if rng.random() < 0.3 else (40 + rng.random(), -75 + rng.random())
    places = [(i, *spot()) for i in range(120)]
    places += [(i + 500, lat, lng) for i, lat, lng in places[:20]] + [(900, None, 1.0), (901, 41.0, 5.0), (899, 41.0, 7.0)]
    points = [(i, *spot()) for i in range(200)] + [(300, 41.0, 6.0), (301, None, 1.0), (302, 1.0, None), (303, 89.5, 0.0), (304, *places[3][1:])]
    got = joins.nearest(rows(points, "pid bigint, lat double, lng double"), rows(places, "sid bigint, lat double, lng double"), "pid", "sid", grid)

    def expected(lat, lng):
        if lat is None or lng is None or abs(lat) >= 89:
            return None
        apart = lambda a, b: round(math.sqrt((a - lat) ** 2 + ((b - lng) * math.cos(math.radians(lat))) ** 2), 9)
        return min((apart(a, b), sid) for sid, a, b in places if a is not None)[1]

    result = {r["pid"]: r["sid"] for r in got.collect()}
    assert result == {pid: expected(lat, lng) for pid, lat, lng in points}
    assert result[300] == 899


def test_nearest_of_no_places(rows):
    points = rows([(1, 1.0, 2.0)], "pid bigint, lat double, lng double")
    places = rows([], "sid bigint, lat double, lng double")
    assert [(r["sid"], r["degrees"]) for r in joins.nearest(points, places, "pid", "sid").collect()] == [(None, None)]
    assert joins.nearest(points.limit(0), places, "pid", "sid").count() == 0


def test_feed_fields_of_other_types_are_kept_and_read_as_null(rows):
    feed = '{"incidents":[{"geometry":{"coordinates":["west",1.5]},"properties":{"iconCategory":"7","events":[{"code":3}]}},{"type":4}],"more":{"a":1}}'
    feeds = rows([(1, feed), (2, '{"incidents":{"a":1}}'), (3, None), (4, '{"other":1}'), (5, "{")], "id bigint, feed string")
    got = trip_insight.feed_items(feeds).select("id", "position", "lng", "lat", "icon_category", "type", F.to_json("item").alias("item")).collect()
    assert [tuple(r)[:5] for r in got] == [(1, 0, None, 1.5, 7), (1, 1, None, None, None)]
    assert '"events":[{"code":3}]' in got[0]["item"]


def test_nearest_orders_only_places_within_reach(rows, monkeypatch):
    """A dense town: each point is compared with the places around it, not with all of the wider cells."""
    made = []
    town = rows([(i, 0.001 * (i % 60), 0.001 * (i // 60)) for i in range(3600)], "place bigint, lat double, lng double")
    asked = rows([(i, 0.001 * i + 0.0004, 0.03) for i in range(60)], "pid bigint, lat double, lng double")
    kind = type(town)
    grouped = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *by: made.append(self) or grouped(self, *by))
    got = joins.nearest(asked, town, "pid", "place", NearGridParams(cell_degrees=0.001))
    pairs = made[-1].count()
    assert sorted(r["place"] for r in got.collect()) == [1800 + i for i in range(60)]
    assert pairs < 60 * 60
    plan = plan_of(got)
    assert "BroadcastNestedLoop" not in plan and "SortMergeJoin" in plan


def test_facts_and_points_of_a_time_answer_like_all(spark, rows):
    draw = random.Random(17)
    at = lambda m: f"2024-03-01 {m // 60 % 24:02d}:{m % 60:02d}:{draw.randrange(3):02d}"
    facts = [(draw.choice(["a", "b", "c", None]), at(draw.randrange(1200)), i // 2, i) for i in range(300)]
    facts = rows([*facts, ("a", None, 900, 900)], "k string, t timestamp_ntz, id bigint, v bigint")
    probes = rows([(i, draw.choice(["a", "b", "d", None]), at(600 + i)) for i in range(90)], "p bigint, k string, asked timestamp_ntz")
    low, high = probes.agg(F.min(clock.micros(F.col("asked"))), F.max(clock.micros(F.col("asked")))).first()
    some = joins.facts_between(facts, "k", "t", "id", low, high)
    assert some.columns == facts.columns and some.filter(clock.micros(F.col("t")) < low).count() == 3 and some.count() < 120
    answer = lambda f: sorted(map(tuple, joins.as_of(probes, f, "k", "asked", "t", "id", ["id"]).select("p", "fact_time", "id").collect()))
    assert answer(some) == answer(facts)
    points = rows(
        [(1, "2024-03-01 08:00:00", "2024-03-01 10:00:00"), (2, "2024-03-01 08:00:00", "2024-03-01 10:00:01"),
         (3, "2024-03-01 11:00:00", None), (4, "2024-03-01 11:00:01", None), (5, None, None), (6, "2024-01-01 00:00:00", None)],
        "p bigint, a timestamp_ntz, b timestamp_ntz",
    )
    low, high = (points.filter(f"p = {p}").select(clock.micros(F.col(c))).first()[0] for p, c in ((1, "b"), (3, "a")))
    assert [r.p for r in joins.points_between(points, "a", "b", low, high).orderBy("p").collect()] == [2, 3, 6]
