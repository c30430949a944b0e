from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from commutelens.operators import regression
from commutelens.plans import demand

NAMES = [f"f{i}" for i in range(7)]


@pytest.fixture
def days(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(80, 10, size=(120, 7))
    y = 1000 + x @ np.arange(1, 8) + rng.normal(0, 5, 120)
    data = [(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "slot bigint, " + ", ".join(f"{n} double" for n in NAMES) + ", total double")


def test_fit_equals_least_squares(days):
    train = days.filter(regression.in_training(F.col("slot")))
    model = regression.fit_linear(train, NAMES, "total")
    got = np.array([[r[n] for n in NAMES] + [r["total"]] for r in train.collect()])
    design = np.column_stack([np.ones(len(got)), got[:, :7]])
    expected = np.linalg.lstsq(design, got[:, 7], rcond=None)[0]
    assert [model.intercept, *model.coefficients] == pytest.approx(list(expected), rel=1e-7)


def test_split_is_stable_and_about_80_percent(days):
    picked = lambda df: {r["slot"] for r in df.filter(regression.in_training(F.col("slot"))).collect()}
    assert picked(days) == picked(days.repartition(7))
    assert 0.7 < len(picked(days)) / 120 < 0.9


def test_projection_extends_features_by_their_drift(days):
    got = {r["step"]: r["prediction"] for r in demand.project_daily(days, NAMES, "total", 3).collect()}
    model = demand.fit_daily(days, NAMES, "total")
    table = np.array([[r[n] for n in NAMES] for r in days.orderBy("slot").collect()])
    drift = np.diff(table, axis=0).mean(axis=0)
    for k in (1, 2, 3):
        expected = model.intercept + (table[-1] + k * drift) @ np.array(model.coefficients)
        assert got[k] == pytest.approx(expected, rel=1e-6)


def test_null_rows_are_left_out(days):
    holed = days.withColumn("f0", F.when(F.col("slot") % 10 != 0, F.col("f0")))
    assert demand.fit_daily(holed, NAMES, "total").numFeatures == 7


def test_holdout_error(days):
    got = demand.holdout_daily(days, NAMES, "total").first()
    model = demand.fit_daily(days, NAMES, "total")
    kept = days.filter(~regression.in_training(F.col("slot"))).collect()
    y = np.array([r["total"] for r in kept])
    p = np.array([model.intercept + np.dot([r[n] for n in NAMES], np.array(model.coefficients)) for r in kept])
    assert got["n"] == len(kept)
    assert got["mse"] == pytest.approx(np.mean((y - p) ** 2), abs=0.01)
    assert got["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), abs=1e-6)


def test_one_fit_per_series_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    data, want = [], {}
    for series in range(40):
        n = int(rng.integers(12, 60))
        x = rng.normal(80, 10, size=(n, 7))
        y = 5 + x @ rng.normal(0, 3, 7) + rng.normal(0, 1, n)
        data += [(f"s{series}", *map(float, row), float(t)) for row, t in zip(x, y, strict=True)]
        want[f"s{series}"] = np.linalg.lstsq(np.column_stack([np.ones(n), x]), y, rcond=None)[0]
    data += [("twins", *map(float, [i, 2 * i, *rng.normal(0, 1, 5)]), float(i)) for i in range(20)]
    data += [("few", *map(float, rng.normal(0, 1, 7)), 1.0), ("flat", *[3.0] * 7, 1.0), ("flat", *[3.0] * 7, 2.0), ("s0", None, *[1.0] * 6, 9.0)]
    df = spark.createDataFrame(data, "k string, " + ", ".join(f"{n} double" for n in NAMES) + ", total double")
    got = {}
    for r in regression.fit_by_series(df, "k", NAMES, "total").collect():
        got.setdefault(r["k"], {})[r["term"]] = r["coefficient"]
    for series, expected in want.items():
        assert [got[series][t] for t in ("intercept", *NAMES)] == pytest.approx(list(expected), rel=1e-6, abs=1e-6)
    assert all(set(got[k].values()) == {None} and len(got[k]) == 8 for k in ("twins", "few", "flat"))
