from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from commutelens.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 8, 4, str(tmp_path_factory.mktemp("work")))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """DataFrame from tuples and a DDL schema; timestamps given as text become zone-free timestamps."""

    def build(data, schema):
        from pyspark.sql import functions as F

        text = schema.replace("timestamp_ntz", "string")
        frame = spark.createDataFrame(data, text)
        for part in schema.split(","):
            name, kind = part.split()
            if kind == "timestamp_ntz":
                frame = frame.withColumn(name, F.col(name).cast("timestamp_ntz"))
        return frame

    return build


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
