"""What reaches the scan and how rows move."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL, plan_of

from catalog.queries import QUERIES


def scans(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("hourly_ridership", {"ts", "event_type", "value"}),
        ("daily_ridership", {"ts", "user_id", "value"}),
        ("emission_factors", {"l_linenumber", "l_quantity", "l_linestatus"}),
        ("stitch_chunks", {"conv_id", "turn", "text"}),
        ("forecast_daily", {"o_orderdate", "o_totalprice"}),
    ],
)
def test_scan_reads_only_what_is_used(spark, name, columns):
    read = {c.split(":")[0] for s in scans(plan_of(QUERIES[name](spark, SMALL))) for c in s.split(",")}
    assert read == columns


@pytest.mark.parametrize(("name", "value"), [("arrival_resolved", "click"), ("incidents_in_bbox", "error"), ("flow_asof", "view")])
def test_filter_reaches_the_scan(spark, name, value):
    assert f"EqualTo(event_type,{value})" in plan_of(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {n for n in QUERIES if n.startswith(("stream", "ols", "forecast_own_model"))}))
def test_no_nested_loop_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for slow in ("BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups"):
        assert slow not in plan


def test_sums_are_partial_before_the_shuffle(spark):
    plan = plan_of(QUERIES["hourly_ridership"](spark, SMALL))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_json_is_parsed_once(spark):
    for name in ("enum_violations", "coalesced_trip", "request_rejects", "parse_or_reject"):
        assert plan_of(QUERIES[name](spark, SMALL)).count("from_json(") == 1


def test_scored_trips_are_evaluated_once(spark):
    """Runner-ups read what was written once, not the tables that trips are made of."""
    for name in ("runner_up_rides", "trip_insights", "travel_time_results"):
        plan = plan_of(QUERIES[name](spark, SMALL))
        assert plan.count("FileScan") == 2 and "events.parquet" not in plan


def test_bundle_folds_lookups_without_joining_them(spark):
    plan = plan_of(QUERIES["traffic_bundle"](spark, SMALL))
    assert "SortMergeJoin" not in plan and plan.count("FileScan") <= 24
    # The folding of box sums, and that of the whole bundle.
    assert len(re.findall(r"Exchange hashpartitioning\(request_id", plan)) == 2


def test_box_totals_are_summed_before_they_move(spark):
    plan = plan_of(QUERIES["incident_load"](spark, SMALL))
    assert "partial_sum" in plan and "NestedLoop" not in plan
