from __future__ import annotations

import hashlib
import math
import random
import re
from zlib import crc32

import pytest

from commutelens.llm import importance
from commutelens.llm.importance import ResampleParams

DOCS = "doc_id bigint, text string, rank int, weight string, id int"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets(text, n):
    w = words(text)
    return [crc32(" ".join(w[i : i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, params):
    n = params.buckets
    held = [buckets(t, n) for _, t in docs]
    s, t = [0] * n, [0] * n
    for b in (x for row in held for x in row):
        s[b] += 1
    for b in (x for text in target for x in buckets(text, n)):
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + n) / ((s[b] + 1) * (sum(t) + n)))) for b in range(n)]
    rows = []
    for (i, text), row in zip(docs, held, strict=True):
        h = int(hashlib.sha256(f"{params.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in row)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([len(words(text)) >= params.least_words, i, len(row), weight, score])
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, -r[3], -r[2]))
    rank = {id(r): place + 1 for place, r in enumerate(able[: len(able) * params.percent // 100])}
    return sorted(((*r[1:], rank.get(id(r))) for r in rows), key=repr)


def got(spark, docs, target, params):
    frame = spark.createDataFrame([(i, t, 1, "w", 2) for i, t in docs], DOCS)
    aims = spark.createDataFrame([(t, 0) for t in target], "text string, score int")
    rows = importance.resample(frame, aims, params=params)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, rows.collect()), key=repr)


def sample(seed):
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice(["Ab", "cd", "é", "日本", "x9", "the"]) for _ in range(n))
    return [(i, text(draw.randint(0, 30))) for i in range(300)], [text(20) for _ in range(5)]


@pytest.mark.parametrize("params", [ResampleParams(), ResampleParams(buckets=7, percent=40, least_words=3, pivots=2, rows_per_range=10), ResampleParams(percent=100, pivots=5, rows_per_range=3)])
def test_matches_brute_force(spark, params):
    docs, target = sample(params.buckets)
    assert got(spark, docs, target, params) == brute(docs, target, params)


@pytest.mark.parametrize("percent", [5, 35, 60])
def test_repeated_rows_and_ties(spark, percent):
    params = ResampleParams(percent=percent, least_words=2, pivots=3, rows_per_range=4, copies_at_once=2)
    docs = [(7, "same words here")] * 40 + [(i, "same words here") for i in range(30)] + [(9, "one and two"), (9, "two and one")]
    assert got(spark, docs, ["same words"], params) == brute(docs, ["same words"], params)


def test_odd_rows(spark):
    params = ResampleParams(percent=50, least_words=1)
    docs = [(1, None), (2, ""), (3, "., \x00"), (None, "a b c"), (None, "a b c"), (None, None), (4, "A b\x00C"), (5, "word " * 30_000), (-6, "a")]
    for target in (["a b", None, ""], [None], []):
        assert got(spark, docs, target, params) == brute(docs, [t or "" for t in target], params)


def test_empty_table(spark):
    assert got(spark, [], ["a"], ResampleParams()) == []
    assert got(spark, [(1, "a b c")], ["a"], ResampleParams()) == brute([(1, "a b c")], ["a"], ResampleParams())


def test_runs_across_blocks_of_words(monkeypatch):
    text = ("one two  Three-four, five " * 40).encode()
    whole = sorted(x for _, found in importance.features(text) for x in found.tolist())
    split = importance.word_blocks
    monkeypatch.setattr(importance, "word_blocks", lambda t: split(t, 3))
    blocks = [*importance.features(text)]
    assert len(blocks) > 50 and sorted(x for _, found in blocks for x in found.tolist()) == whole == sorted(buckets(text.decode(), 10_000))
