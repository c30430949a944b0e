"""Ordered neighbours and top-k within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commutelens.session import new_folder, stage


def first_k(rides: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """First k rows per group; Spark cuts each task's rows to k per group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return rides.withColumn("position", rank).filter(F.col("position") <= k)


def following(
    rides: DataFrame,
    group: Sequence[str],
    order: str,
    row_id: str,
    payload: Sequence[str],
    k: int,
    ranges: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Each row with the next ``k`` rows of its group in (order, id) order, as array ``next_rides``.

    A group may hold a third of all rows, so rows are dealt to ranges of (group, order, id), which cut any group, and
    written once with the number of their range; ``rides`` is evaluated for that and never again. One window finds the
    successors inside a group's part of a range. The last k rows there go on in a halo: the first k rows of the group's
    parts after it, of which there is one row per part.

    ``ranges`` is the number of ranges, or the session's number of shuffle partitions. The written rows lie in
    ``folder``, or in a new folder on shared storage; whoever owns the run removes it.
    """
    key = [*group, order, row_id]
    dealt = rides.repartitionByRange(ranges, *key) if ranges else rides.repartitionByRange(*key)
    rows = stage(dealt.withColumn("_range", F.spark_partition_id()), folder or new_folder(rides.sparkSession, "following"))

    part = [*group, "_range"]
    item = F.struct(F.col(row_id), F.col(order), *payload)
    inside = W.partitionBy(*part).orderBy(order, row_id).rowsBetween(1, k)
    placed = rows.withColumn("_inside", F.collect_list(item).over(inside))

    first = F.row_number().over(W.partitionBy(*part).orderBy(order, row_id))
    heads = (
        rows.select(*part, row_id, order, *[c for c in payload if c not in key])
        .withColumn("_place", first)
        .filter(F.col("_place") <= k)
        .groupBy(*part)
        .agg(F.array_sort(F.collect_list(F.struct("_place", item.alias("item")))).alias("_head"))
    )
    # Every part has a row, so k parts after this one hold k rows.
    after = W.partitionBy(*group).orderBy("_range").rowsBetween(1, k)
    halo = heads.select(
        *[F.col(c).alias(f"_of_{c}") for c in part],
        F.slice(F.flatten(F.collect_list(F.transform("_head", lambda h: h["item"])).over(after)), 1, k).alias("_halo"),
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part])
    both = F.slice(F.concat("_inside", F.coalesce("_halo", F.array().cast(halo.schema["_halo"].dataType))), 1, k)
    return placed.join(halo, same, "left").select(*rides.columns, both.alias("next_rides"))
