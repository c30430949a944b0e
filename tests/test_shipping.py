"""Executors that start in another folder find the package in what the session ships."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from commutelens.operators import forecast
from commutelens.session import local_session
import pandas as pd

def last(values, horizon):
    return pd.DataFrame({{"step": range(1, horizon + 1), "q10": values.iloc[-1], "q50": values.iloc[-1], "q90": values.iloc[-1]}})

spark = local_session("foreign", 2, 2, {work!r})
spark.sparkContext.addPyFile({package!r})
series = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0)], "series_key string, slot bigint, y double")
print("steps", sorted((r.step, r.q50) for r in forecast.forecast_with_model(series, 2, last).collect()))
spark.stop()
"""


def test_python_functions_run_from_a_foreign_folder(tmp_path):
    package = shutil.make_archive(str(tmp_path / "commutelens"), "zip", ROOT, "commutelens")
    script, away = tmp_path / "job.py", tmp_path / "away"
    script.write_text(SCRIPT.format(root=str(ROOT), package=package, work=str(tmp_path / "work")))
    away.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script)], cwd=away, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "steps [(1, 7.0), (2, 7.0)]" in run.stdout, run.stderr[-2000:]
