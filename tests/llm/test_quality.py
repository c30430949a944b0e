from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from commutelens.llm import quality
from commutelens.llm.queries import op2_quality

FOLDER = "/root/testdata/sf0.01"


def area_under_curve(labels, scores):
    order = np.argsort(np.argsort(scores))
    good = labels == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = op2_quality(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    given = np.array([labels[r.doc_id] for r in held])
    assert area_under_curve(given, np.array([r.score for r in held])) > 0.98
    assert (given == [r.predicted for r in held]).mean() > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    may = quality.learnable(F.col("doc_id"))
    flipped = labels.withColumn("quality", F.when(may, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = quality.train(docs, labels, may), quality.train(docs, flipped, may)
    assert np.allclose(a.weights, b.weights) and a.prior == b.prior


def test_risk_and_prior_without_negative_labels():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(0, 1, (4000, len(quality.FEATURES))), draw.normal(0, 1, (4000, len(quality.FEATURES)))
    bad[:, 0] += 6
    mixed = np.vstack([good[2000:], bad[:1000]])
    model = quality.fit(good[:2000], mixed, None)
    assert 0.5 < model.prior < 0.85
    right = np.r_[model.scores(good[:2000]) >= 0.5, model.scores(bad[1000:]) < 0.5]
    assert right.mean() > 0.95


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "x" * 200_000), (4, "same text"), (4, "same text"), (None, "no id")])
    docs = docs.withColumnRenamed("lang", "f").withColumnRenamed("source", "given")
    labels = spark.createDataFrame([(4, 1), (4, None), (2, 0), (3, 1), (None, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels, F.lit(True))
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert quality.train(docs, labels.filter("quality = 0"), F.lit(True)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), labels, F.lit(True)) is None
