from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from commutelens.operators import forecast
from commutelens.params import DAILY_FALLBACK, HOURLY_FALLBACK
from commutelens.plans import demand

SERIES = "series_key string, slot bigint, y bigint"


@pytest.fixture
def history(rows):
    rng = np.random.default_rng(3)
    return rows([(k, int(i), int(rng.integers(0, 90))) for k in ("a", "b") for i in range(100, 190)], SERIES)


def test_quantiles_equal_numpy_at_the_phase(history):
    values = {(r["series_key"], r["slot"]): r["y"] for r in history.collect()}
    got = forecast.seasonal_forecast(history, 30, 24).collect()
    assert len(got) == 60
    for r in got:
        assert r["slot"] == 189 + r["step"]
        sample = [y for (k, s), y in values.items() if k == r["series_key"] and s % 24 == r["slot"] % 24]
        band = np.quantile(sample, [0.1, 0.5, 0.9])
        assert (r["q10"], r["q50"], r["q90"]) == pytest.approx(tuple(band), abs=1e-6)
        assert r["prediction"] == np.floor(round(band[1], 6)) and r["n"] == len(sample)
        assert r["q10"] <= r["q50"] <= r["q90"]


def test_drift_quantiles_equal_numpy(history):
    got = {(r["series_key"], r["step"]): r for r in forecast.drift_forecast(history, 5).collect()}
    for key in ("a", "b"):
        ys = np.array([r["y"] for r in history.filter(F.col("series_key") == key).orderBy("slot").collect()])
        for h in range(1, 6):
            assert got[key, h]["q50"] == pytest.approx(ys[-1] + np.median(ys[h:] - ys[:-h]), abs=1e-6)


def test_requests(rows, history):
    asked = rows([(1, "a", 0), (2, "a", 25), (3, "a", -2), (4, "zzz", 3), (5, "a", None), (6, "a", 1)], "id bigint, series_key string, horizon bigint")
    profile = forecast.seasonal_profile(history, 24)
    got = {r["id"]: r["prediction"] for r in forecast.answer(asked, profile, 24).collect()}
    assert got[1] == 0 and got[3] == 0
    assert got[4] is None and got[5] is None
    assert got[2] == got[6]  # 25 hours ahead is the phase of one hour ahead


def test_horizon_text(rows):
    texts = ["0", "25", "-3", "2.5", "soon", "", "99999999999", None]
    df = rows([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(forecast.valid_horizon(F.col("t"))).collect()] == [0, 25] + [None] * 6


@pytest.mark.parametrize("fallback", [HOURLY_FALLBACK, DAILY_FALLBACK])
def test_fallback_tiers(rows, fallback):
    history = rows([(1, 0, 5), (1, 24, 7), (2, 0, 11)], "series_key bigint, slot bigint, y bigint")
    asked = rows([(1, 24), (2, 3), (3, 1), (4, 1), (4, 24), (3, 0), (1, None), (2**62, 1), (-(2**62), 1)], "series_key bigint, horizon bigint")
    got = {(r["series_key"], r["horizon"]): (r["prediction"], r["source"]) for r in forecast.with_fallback(asked, history, 24, fallback, "series_key").collect()}
    assert got[1, 24] == (6, "phase")
    assert got[2, 3] == (11, "series")
    assert got[3, 0] == (0, "none")
    assert got[1, None] == (None, "invalid")
    assert got[4, 24] == (7, "pooled")
    for key in (3, 4, 2**62, -(2**62)):
        value, source = got[key, 1]
        assert source == "base" and fallback.base - fallback.variation <= value < fallback.base + fallback.variation


def test_empty_history_gives_no_forecast(rows):
    assert forecast.seasonal_forecast(rows([], SERIES), 24, 24).count() == 0


def test_single_value_series(rows):
    got = forecast.seasonal_forecast(rows([("a", 10, 4)], SERIES), 48, 24).collect()
    assert sorted(r["step"] for r in got) == [24, 48] and all(r["q10"] == r["q90"] == 4 for r in got)


def test_user_model_plugs_in(history):
    def repeat_last(values: pd.Series, horizon: int) -> pd.DataFrame:
        last = float(values.iloc[-1])
        return pd.DataFrame({"step": range(1, horizon + 1), "q10": last, "q50": last, "q90": last})

    got = demand.forecast_method(history, 3, "model", model=repeat_last)
    lasts = {r["series_key"]: r["y"] for r in history.filter(F.col("slot") == 189).collect()}
    assert {(r["series_key"], r["step"]): r["q50"] for r in got.collect()} == {
        (k, s): float(v) for k, v in lasts.items() for s in (1, 2, 3)
    }


def test_unknown_method(history):
    with pytest.raises(ValueError, match="unknown method"):
        demand.forecast_method(history, 1, "magic")


def test_backtest_uses_only_the_past(rows):
    data = [("a", s, 10) for s in range(48)] + [("a", s, 20) for s in range(48, 72)]
    cutoffs = F.array(F.lit(48).cast("bigint"))
    results = forecast.backtest(rows(data, SERIES), cutoffs, 24, 24)
    assert {(r["q50"], r["actual"]) for r in results.collect()} == {(10.0, 20.0)}
    error = forecast.error_by_step(results).first()
    assert (error["mse"], error["mape"], error["coverage_80"]) == (100.0, 0.5, 0.0)


def test_constant_results_have_no_correlation(rows):
    same = rows([(1, 5.0, 4.0, 5.0, 6.0), (1, 5.0, 4.0, 5.0, 6.0)], "step bigint, actual double, q10 double, q50 double, q90 double")
    got = forecast.error_by_step(same).first()
    assert got["trend_corr"] is None and got["coverage_80"] == 1.0


def test_service_answers_every_request(rows):
    history = rows([(1, 0, 5), (1, 24, 7)], "series_key bigint, slot bigint, y bigint")
    asked = rows(
        [(1, "24", "2024-01-01 00:00:00"), (9, "2", "2024-01-01 00:00:00"), (1, "x", "2024-01-01 00:00:00")],
        "series_key bigint, horizon_text string, asked_at timestamp_ntz",
    )
    got = demand.respond(asked, history, demand.HOURLY_SERVICE, "series_key").collect()
    by_text = {r["horizon_text"]: (r["failed"], json.loads(r["envelope"])) for r in got}
    assert by_text["24"][1]["prediction"] == 6 and by_text["24"][1]["hours_future"] == 24
    assert 30 <= by_text["2"][1]["prediction"] < 70
    assert by_text["x"][0] and by_text["x"][1]["hours_requested"] == "x"


def test_rolling_backtest_sees_only_earlier_days(rows):
    data = [("a", day * 24 + hour, 10 * day + hour) for day in (0, 1, 2, 4) for hour in (0, 5)] + [("b", 24 + 5, 1)]
    got = forecast.rolling_backtest(rows(data, SERIES), 24).collect()
    assert {(r["series_key"], r["cutoff"], r["step"]): (r["actual"], r["q50"]) for r in got} == {
        ("a", day * 24, hour + 1): (10.0 * day + hour, past + hour) for day, past in ((1, 0.0), (2, 5.0), (4, 10.0)) for hour in (0, 5)
    }
    versions = forecast.profile_versions(rows(data, SERIES), 24).filter("series_key = 'a' AND phase = 5").orderBy("since").collect()
    assert [(r["since"], r["q50"], r["n"]) for r in versions] == [(24, 5.0, 1), (48, 10.0, 2), (72, 15.0, 3), (120, 20.0, 4)]
