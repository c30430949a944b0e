"""Sums over the points in moving boxes without making the pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commutelens.functions import clock
from commutelens.operators import joins
from commutelens.params import GRID, SUM_GRID, GridParams, SumGridParams

NODE = ("_hx", "_x", "_hy", "_y")


def running_totals(
    probes: DataFrame, events: DataFrame, key: Sequence[str], time: str, amounts: Sequence[str], bucket_minutes: int = 60
) -> DataFrame:
    """Each probe with the sums of its key's ``amounts`` over all events at or before its time, 0 without events.

    Events are summed per key and moment first. A key's timeline is cut into buckets; the sums of whole buckets are
    carried forward over one row per bucket and enter a bucket as its opening row, so the sorted window spans a bucket.
    """
    bucket = clock.minute_bucket(F.col(time), bucket_minutes)

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*key, *by).agg(*[F.sum(a).alias(a) for a in amounts])

    none = {a: F.lit(0).cast("bigint") for a in amounts}
    moments = summed(events, time).withColumn("_bucket", bucket)
    asking = probes.select("*", bucket.alias("_bucket"))
    asked = asking.select(*key, "_bucket").distinct().withColumns(none).withColumn("_asked", F.lit(True))
    timeline = (
        summed(moments, "_bucket")
        .withColumn("_asked", F.lit(False))
        .unionByName(asked)
        .groupBy(*key, "_bucket")
        .agg(*[F.sum(a).alias(a) for a in amounts], F.max("_asked").alias("_asked"))
    )
    before = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    openings = timeline.withColumns({a: F.sum(a).over(before) for a in amounts}).filter(
        F.col("_asked") & F.col(amounts[0]).isNotNull()
    )
    rows = (
        moments.withColumn("_rank", F.lit(1))
        .unionByName(openings.drop("_asked").withColumn("_rank", F.lit(0)), allowMissingColumns=True)
        .unionByName(asking.withColumns(none).withColumn("_rank", F.lit(2)), allowMissingColumns=True)
    )
    # The opening row has no time and sorts first; at equal times events come before probes.
    inside = W.partitionBy(*key, "_bucket").orderBy(F.col(time).asc_nulls_first(), "_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = rows.withColumns({a: F.sum(a).over(inside) for a in amounts})
    return total.filter(F.col("_rank") == 2).select(*probes.columns, *amounts)


def _cell(x: Column, grid: SumGridParams) -> Column:
    return F.floor(x / F.lit(grid.cell_degrees))


def _runs(boxes: DataFrame, low: str, end: str, height: str, place: str, grid: SumGridParams) -> DataFrame:
    """Boxes once per run of cells from ``low`` to before ``end`` (columns of cell numbers): runs ``place`` of 2^``height``
    cells, as few as there can be."""
    # Runs of height h lie from start to before end. One at an odd place belongs to no run of twice its size, so a height has
    # at most one at either side; of the greatest height all are taken. Plain arithmetic on a number per possible run: lambdas
    # over arrays are interpreted, which took longer than all else here.
    top = grid.heights - 1
    start = lambda h: f"-shiftright(-`{low}`, {h})"
    stop = lambda h: f"shiftright(`{end}`, {h})"
    slots = f"sequence(0, {2 * top} + greatest(0, cast({stop(top)} - ({start(top)}) AS int)))"
    run = f"""
        CASE WHEN _slot >= {2 * top} THEN nullif(least({start(top)} + _slot - {2 * top}, {stop(top)}), {stop(top)})
             WHEN {start("_h")} >= {stop("_h")} THEN NULL
             WHEN _slot & 1 = 0 AND ({start("_h")}) & 1 = 1 THEN {start("_h")}
             WHEN _slot & 1 = 1 AND {stop("_h")} & 1 = 1 THEN {stop("_h")} - 1 END"""
    listed = boxes.withColumn("_slot", F.explode(F.expr(slots))).withColumn("_h", F.expr(f"least(shiftright(_slot, 1), {top})"))
    return listed.withColumn(place, F.expr(run)).filter(F.col(place).isNotNull()).withColumnRenamed("_h", height).drop("_slot")


def totals_in_boxes(
    boxes: DataFrame,
    points: DataFrame,
    box_id: str,
    moment: str,
    valid_from: str,
    valid_to: str,
    amounts: Sequence[str],
    grid: SumGridParams = SUM_GRID,
    time_grid: GridParams = GRID,
) -> DataFrame:
    """(box_id, amounts): sums of the whole numbers ``amounts`` over the points in each box (edges included) that are
    valid at its moment. Boxes without a coordinate, a moment or such a point have no row.

    A box is a rectangle of cells. Both axes have inner cells, split into runs of 1, 2, 4 ... cells, and two outer ones, which
    the box may cover in part. So the box becomes a few dozen rectangles, whatever its size:

    * In a rectangle of inner runs every point counts. Points add to all rectangles of runs that hold them when they begin
      to be valid, and are taken off when they end, so a running total over time answers with one row.
    * Outer cells meet their points one by one. These are four strips one cell wide, split into runs along the edge.

    Work follows the number of boxes and points; pairs are made only along the edges of boxes.
    """
    known = boxes.filter(F.col("south").isNotNull() & F.col("west").isNotNull() & F.col("north").isNotNull() & F.col("east").isNotNull())
    sides = ["south", "west", "north", "east"]
    cells = {f"_{i}": _cell(F.col(side), grid) for side, i in (("south", "x0"), ("north", "x1"), ("west", "y0"), ("east", "y1"))}
    split = known.filter(F.col(moment).isNotNull()).select(box_id, moment, *sides).withColumns(cells)
    placed = points.select("lat", "lng", valid_from, valid_to, *amounts).filter("lat IS NOT NULL AND lng IS NOT NULL")
    valid = joins.valid_points(placed, valid_from, valid_to, time_grid).withColumns({"_cx": _cell(F.col("lat"), grid), "_cy": _cell(F.col("lng"), grid)})

    def in_runs(frame: DataFrame) -> DataFrame:
        heights = F.sequence(F.lit(0), F.lit(grid.heights - 1))
        spread = frame.withColumn("_hx", F.explode(heights)).withColumn("_hy", F.explode(heights))
        return spread.withColumns({"_x": F.expr("shiftright(_cx, _hx)"), "_y": F.expr("shiftright(_cy, _hy)")}).drop("_cx", "_cy")

    changes = F.array(
        F.struct(F.col(valid_from).alias(moment), *[F.col(a).cast("bigint").alias(a) for a in amounts]),
        F.struct(F.col(valid_to).alias(moment), *[(-F.col(a)).cast("bigint").alias(a) for a in amounts]),
    )
    events = valid.select("_cx", "_cy", F.inline(changes)).filter(F.col(moment).isNotNull())
    events = events.groupBy("_cx", "_cy", moment).agg(*[F.sum(a).alias(a) for a in amounts])
    within = split.select(box_id, moment, "_x1", "_y1", (F.col("_x0") + 1).alias("_x0"), (F.col("_y0") + 1).alias("_y0"))
    whole = _runs(_runs(within, "_x0", "_x1", "_hx", "_x", grid), "_y0", "_y1", "_hy", "_y", grid).select(box_id, moment, *NODE)
    inner = running_totals(whole, in_runs(events), NODE, moment, amounts, grid.bucket_minutes).select(box_id, *amounts)

    key = [*NODE, "_rung", "_bucket"]
    # The strips at west and east reach over both outer cells, those at south and north lie between them. A box within one
    # row of cells has one strip: the other one of the two gets no cells.
    strips = F.expr("""
        inline(array(struct(true AS _along_x, _y0 AS _at, _x0 AS _low, _x1 + 1 AS _end),
                     struct(true AS _along_x, _y1 AS _at, _x0 AS _low, IF(_y1 = _y0, _x0, _x1 + 1) AS _end),
                     struct(false AS _along_x, _x0 AS _at, _y0 + 1 AS _low, _y1 AS _end),
                     struct(false AS _along_x, _x1 AS _at, IF(_x1 = _x0, _y1, _y0 + 1) AS _low, _y1 AS _end)))""")
    timed = joins.boxes_by_time(split, valid, moment, time_grid).select(box_id, moment, *sides, "_rung", "_bucket", strips)
    along = lambda inside, across: F.when(F.col("_along_x"), inside).otherwise(across)
    nodes = (along(F.col("_h"), F.lit(0)), along(F.col("_i"), F.col("_at")), along(F.lit(0), F.col("_h")), along(F.col("_at"), F.col("_i")))
    edges = _runs(timed.filter("_low < _end"), "_low", "_end", "_h", "_i", grid).select(
        box_id, moment, *sides, "_rung", "_bucket", *[n.alias(c) for n, c in zip(nodes, NODE, strict=True)]
    )
    near = in_runs(joins.points_by_time(valid, valid_from, valid_to, time_grid)).filter("_hx = 0 OR _hy = 0")
    # Sizes that Spark estimates know nothing of the rows listed here: without the hint either side may be broadcast
    # through the driver, many times as large as thought. A partition's points are hashed, boxes stream past them.
    near = near.hint("shuffle_hash")
    outer = edges.join(near, key).filter(joins.is_inside(moment, valid_from, valid_to)).select(box_id, *amounts)
    total = inner.unionByName(outer).groupBy(box_id).agg(*[F.sum(a).alias(a) for a in amounts])
    return total.filter(" OR ".join(f"`{a}` <> 0" for a in amounts))
