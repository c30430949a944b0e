from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from commutelens.llm import topk
from commutelens.llm.topk import TopkParams

SCHEMA = "vec_id bigint, embedding array<float>, norm int"


def brute(rows, k, scale):
    def numbers(v):
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v)
        return [math.floor(scale * x) for x in v] if ok else None

    kept = [(i, n) for i, v, _ in rows if i is not None and (n := numbers(v)) is not None]
    out = []
    for query in sorted({i for i, _ in kept if i % 3 == 0}):
        q = min(n for i, n in kept if i == query)
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=False)))), i) for i, v in kept if i != query)[:k]
        out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("lengths", ["equal", "spread"])
def test_matches_brute_force(spark, lengths):
    draw = random.Random(lengths)
    rows = []
    for i in range(400):
        size = 1.0 if lengths == "equal" else math.exp(draw.gauss(0, 1.5))
        rows.append((i, [size * draw.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)], 0))
    rows += [(1000 + i, [1.0] * 6, 0) for i in range(60)] + [(7, [0.5] * 6, 0), (7, [0.5] * 6, 0)]
    params = TopkParams(k=4, scale=8, part=50, page=16, longest=20)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 3 == 0, params=params)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 8)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (3, None, 1), (6, [float("nan"), 1.0], 1), (9, [None, 1.0], 1), (None, [9.0, 9.0], 1),
        (12, [], 1), (1, [float("inf")], 1), (2, [3.0], 1), (4, [3e30, 0.0], 1), (15, [1e7] * 5, 1), (5, [1e7] * 5, 1),
    ]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 3 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 1024)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 3 == 0).count() == 0
