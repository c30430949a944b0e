"""Benchmark: runs the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (folder of parquet tables), BENCH_CPUS (local cores), BENCH_QUERIES (comma list or
"all"), BENCH_REPEAT (timed runs per query; the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import QUERIES  # noqa: E402
from commutelens.session import local_session  # noqa: E402

HEADLINE = (
    "hourly_ridership",
    "daily_mode_wide",
    "ridership_cube",
    "hour_gapfill",
    "ffill_hours",
    "forecast_hourly",
    "forecast_daily",
    "forecast_drift",
    "forecast_request",
    "forecast_with_fallback",
    "backtest_error",
    "ols_forecast",
    "trip_endpoints",
    "flow_asof",
    "incidents_in_bbox",
    "trip_ridership",
    "traffic_bundle",
    "runner_up_rides",
    "trip_insights",
    "parse_or_reject",
    "missing_key_counts",
    "stitch_chunks",
    "emission_factors",
    "stream_hourly",
)


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))

    work = tempfile.TemporaryDirectory(prefix="bench-")
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8, work.name)
    spark.sparkContext.setLogLevel("OFF")
    timed(spark, "hourly_ridership", folder)  # start-up of the JVM and the scan code is not measured
    seconds = {n: round(min(timed(spark, n, folder) for _ in range(repeat)), 3) for n in names}
    print(
        json.dumps(
            {
                "metric": "headline query wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()
    work.cleanup()


if __name__ == "__main__":
    main()
