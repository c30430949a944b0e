"""Target-distribution importance resampling over hashed n-gram features.

Every run of one to three words is a feature and falls into one of a fixed number of buckets. One pass counts the buckets
of all documents and of the target texts; a second one scores each document with the array of log-ratio gains. Gumbel
noise from the id's hash turns the k highest sums into a draw without replacement.

The k-th highest key is found by distributed quickselect: random keys of the range still open are the pivots, one pass
counts exactly how many rows lie before, at and after each of them, and the range shrinks to the gap that holds the k-th.
With 64 pivots every pass leaves about a sixty-fourth of the rows. Only rows up to that key are ordered: folded by key,
dealt to ranges of the order, and ranked inside a range from the number of rows in the ranges before it. No task orders
all of them, and rows that are not drawn are never sorted.

Results: null, empty and wordless texts have no features and weight 0. Documents are ordered by score descending, id
ascending, null ids last, and rows under one id and score by weight and number of features, both descending. Rows that are
equal in all of these are interchangeable: as many of them are drawn as there is room for. A null id is hashed as empty
text. Null and empty target texts, or none at all, add nothing; smoothing keeps gains finite. Repeated rows are documents
of their own. All columns but id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commutelens.llm.shared import written
from commutelens.llm.terms import word_blocks


@dataclass(frozen=True)
class ResampleParams:
    buckets: int = 10_000
    longest_run: int = 3
    #: Documents with fewer words are scored, but not drawn.
    least_words: int = 20
    #: Share of the documents with enough words to draw, in percent, and the seed of the noise.
    percent: int = 5
    seed: int = 42
    #: Pivot keys per pass, rows that one task ranks, and copies of one row written at once.
    pivots: int = 64
    rows_per_range: int = 200_000
    copies_at_once: int = 65_536


PARAMS = ResampleParams()
#: Ascending in all columns is the order of the draw.
KEY = ("down", "no_id", "id", "weight_down", "features_down")


def features(text: bytes | None, params: ResampleParams = PARAMS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the runs that end in one of them), block by block. The checksum of a run goes on from
    that of the run without its last word."""
    before: list[bytes] = []
    for block in word_blocks(text):
        words = before + block
        spaced = [b" " + word for word in words]
        sums, found = [*map(crc32, words)], []
        for n in range(1, params.longest_run + 1):
            if n > 1:
                sums = [*map(crc32, spaced[n - 1 :], sums)]
            found += sums[max(0, len(before) - n + 1) :]  # runs inside the words before are counted already
        yield len(block), np.array(found, np.int64) % params.buckets
        before = words[len(words) - params.longest_run + 1 :] if len(words) >= params.longest_run else words


def bucket_counts(df: DataFrame, text: str, params: ResampleParams) -> np.ndarray:
    """Number of features per bucket over the whole frame; a task sends one row per bucket."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(params.buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, buckets in features(value.as_py(), params):
                    if len(buckets) < params.buckets:
                        np.add.at(total, buckets, 1)
                    else:
                        total += np.bincount(buckets, minlength=params.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    tallied = df.select(F.col(text).cast("binary").alias("text")).mapInArrow(tally, "bucket bigint, n bigint")
    counts = np.zeros(params.buckets, np.int64)
    for row in tallied.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray, params: ResampleParams = PARAMS) -> np.ndarray:
    """What a feature adds to a document's weight, per bucket: thousandths of the smoothed log ratio, rounded down."""
    seen, wanted = int(corpus.sum()) + params.buckets, int(target.sum()) + params.buckets
    pairs = zip(target.tolist(), corpus.tolist(), strict=True)
    return np.array([floor(1000 * log(float((t + 1) * seen) / float((s + 1) * wanted))) for t, s in pairs], np.int64)


def noise(doc_id: Column, params: ResampleParams = PARAMS) -> Column:
    """Thousandths of a standard Gumbel number that follows from the id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**32))
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("bigint")


def scored(docs: DataFrame, values: np.ndarray, doc_id: str, text: str, params: ResampleParams) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document."""

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def weigh(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            words = size = weight = 0
            for n, buckets in features(value.as_py(), params):
                words, size, weight = words + n, size + len(buckets), weight + int(values[buckets].sum())
            rows.append({"n_words": words, "n_features": size, "weight": weight})
        return pa.array(rows, pa.struct([(c, pa.int64()) for c in ("n_words", "n_features", "weight")]))

    weighed = docs.select(F.col(doc_id).cast("bigint").alias("id"), weigh(F.col(text).cast("binary")).alias("f"))
    return weighed.select("id", "f.*", (F.col("f.weight") + noise(F.col("id"), params)).alias("score"))


def _literal(key: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("boolean" if isinstance(v, bool) else "bigint").alias(c) for c, v in zip(KEY, key, strict=True)])


def kth_key(rows: DataFrame, k: int, params: ResampleParams = PARAMS) -> tuple | None:
    """The k-th key in ascending order of rows with the columns ``KEY``, from 1; None if there are fewer rows."""
    key = F.struct(*KEY)
    low, high, before, turn = None, None, 0, 0
    while True:
        still = rows
        if low is not None:  # the plain comparison lets the scan skip row groups
            still = still.filter((F.col("down") >= low[0]) & (key > _literal(low)))
        if high is not None:
            still = still.filter((F.col("down") <= high[0]) & (key < _literal(high)))
        picked = still.orderBy(F.xxhash64(F.lit(turn), *KEY)).limit(params.pivots).select(*KEY).collect()
        pivots = sorted({tuple(row) for row in picked})
        if not pivots:
            return None
        stand = F.array(*map(_literal, pivots))
        placed = still.select(F.size(F.filter(stand, lambda p: p < key)).alias("place"), F.array_contains(stand, key).alias("at"))
        counts = {(r.place, r.at): r["n"] for r in placed.groupBy("place", "at").agg(F.count(F.lit(1)).alias("n")).collect()}
        for place, pivot in enumerate([*pivots, None]):
            between = counts.get((place, False), 0)
            if before + between >= k:
                low, high, turn = pivots[place - 1] if place else low, pivot or high, turn + 1
                break
            before += between
            if pivot is None:
                return None
            at = counts[place, True]
            if before + at >= k:
                return pivot
            before += at


def ranked(winners: DataFrame, n: int, params: ResampleParams = PARAMS) -> DataFrame:
    """Adds ``rank`` to ``n`` rows with the columns ``KEY``: their places in ascending order, from 1."""
    folded = winners.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))
    ranges = folded.repartitionByRange(max(1, -(-n // params.rows_per_range)), *KEY)
    dealt = written(ranges.withColumn("range", F.spark_partition_id()), "drawn")
    sizes = dealt.groupBy("range").agg(F.sum("copies").alias("size"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("range").orderBy(*KEY).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.col("start") + F.sum("copies").over(inside)
    placed = dealt.join(starts, "range").select(*KEY, (last - F.col("copies") + 1).alias("first"), last.alias("last"))
    step = params.copies_at_once
    blocks = placed.withColumn("first", F.explode(F.sequence("first", "last", F.lit(step).cast("bigint"))))
    each = F.explode(F.sequence("first", F.least(F.col("last"), F.col("first") + step - 1)))
    return blocks.select(*KEY, each.alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", params: ResampleParams = PARAMS
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null for those not drawn."""
    values = gains(bucket_counts(docs, text, params), bucket_counts(target, target_text, params), params)
    table = written(scored(docs, values, doc_id, text, params), "scored").select(
        (-F.col("score")).alias("down"),
        F.col("id").isNull().alias("no_id"),
        F.coalesce("id", F.lit(0).cast("bigint")).alias("id"),
        (-F.col("weight")).alias("weight_down"),
        (-F.col("n_features")).alias("features_down"),
        (F.col("n_words") >= params.least_words).alias("eligible"),
    )
    eligible = table.filter("eligible").select(*KEY)
    k = eligible.count() * params.percent // 100
    last = kth_key(eligible, k, params) if k else None
    result = table.withColumn("rank", F.lit(None).cast("bigint"))
    if last is not None:
        chosen = F.struct(*KEY) <= _literal(last)
        drawn = ranked(eligible.filter((F.col("down") <= last[0]) & chosen), k, params)
        drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
        result = result.filter(~(F.col("eligible") & chosen)).drop("eligible").unionByName(drawn)
    return result.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        (-F.col("features_down")).alias("n_features"),
        (-F.col("weight_down")).alias("weight"),
        (-F.col("down")).alias("score"),
        "rank",
    )
