"""Lookup, as-of and box joins that stay equi-joins or bounded windows under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commutelens.functions import clock
from commutelens.params import GRID, NEAR_GRID, GridParams, NearGridParams


def endpoints(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """Coordinates of departure and destination; unknown stops leave nulls.

    No broadcast is forced: Spark broadcasts the stop table while its size is under the session's threshold
    and otherwise shuffles, with adaptive execution splitting a hot stop.
    """
    place = stops.select("stop", "stop_id", "lat", "lng")

    def side(prefix: str) -> DataFrame:
        return place.select(
            F.col("stop").alias(f"{prefix}_stop"),
            F.col("stop_id").alias(f"{prefix}_id"),
            F.col("lat").alias(f"{prefix}_lat"),
            F.col("lng").alias(f"{prefix}_lng"),
        )

    return requests.join(side("dep"), "dep_stop", "left").join(side("dst"), "dst_stop", "left")


def endpoints_by_place(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops at the coordinates a request carries (``dep_lat, dep_lng, dst_lat, dst_lng``), as ``endpoints`` names them.

    Clients take coordinates from the stop list, so equality is exact. Where two stops share a place, the one
    with the smallest id counts, and no request is doubled.
    """
    place = stops.groupBy("lat", "lng").agg(F.min(F.struct("stop_id", "stop")).alias("at"))

    def side(prefix: str) -> DataFrame:
        return place.select(
            F.col("lat").alias(f"{prefix}_lat"),
            F.col("lng").alias(f"{prefix}_lng"),
            F.col("at.stop_id").alias(f"{prefix}_id"),
            F.col("at.stop").alias(f"{prefix}_stop"),
        )

    return requests.join(side("dep"), ["dep_lat", "dep_lng"], "left").join(side("dst"), ["dst_lat", "dst_lng"], "left")


def matched(located: DataFrame) -> DataFrame:
    return located.filter(F.col("dep_id").isNotNull() & F.col("dst_id").isNotNull())


def unknown_ends() -> Column:
    """Names of the ends that are no known stop, empty if both are."""
    return F.concat_ws(
        ",",
        F.when(F.col("dep_id").isNull(), F.lit("departure")),
        F.when(F.col("dst_id").isNull(), F.lit("destination")),
    )


def unmatched(located: DataFrame) -> DataFrame:
    """Requests with an unknown endpoint, naming which."""
    return located.filter(F.col("dep_id").isNull() | F.col("dst_id").isNull()).withColumn("unknown", unknown_ends())


def as_of(
    probes: DataFrame,
    facts: DataFrame,
    key: str,
    probe_time: str,
    fact_time: str,
    fact_id: str,
    values: Sequence[str],
    bucket_minutes: int = 1,
) -> DataFrame:
    """Each probe with the latest fact of its key at or before it; probes without one keep nulls.

    A window over a whole key would put a hot key into one task. Here a key's timeline is cut into buckets: each bucket's
    closing fact is aggregated (map side first), carried forward over one row per bucket, and enters the next bucket as
    its opening row. The sorted window then spans one bucket only, and the carry window grows with the time covered, not
    with the number of facts.
    """
    f = facts.filter(F.col(key).isNotNull() & F.col(fact_time).isNotNull()).select(
        F.col(key),
        clock.minute_bucket(F.col(fact_time), bucket_minutes).alias("_bucket"),
        F.col(fact_time).alias("_t"),
        F.col(fact_id).alias("_id"),
        F.struct(F.col(fact_time).alias("fact_time"), *values).alias("_fact"),
    )
    probe_columns = [c for c in probes.columns if c != key]
    p = probes.select(
        F.col(key),
        clock.minute_bucket(F.col(probe_time), bucket_minutes).alias("_bucket"),
        F.col(probe_time).alias("_t"),
        F.struct(*probe_columns).alias("_probe"),
    )
    closings = f.groupBy(key, "_bucket").agg(F.max_by("_fact", F.struct("_t", "_id")).alias("_fact"), F.lit(False).alias("_asked"))
    asked = p.select(key, "_bucket").distinct().withColumn("_asked", F.lit(True))
    timeline = (
        closings.unionByName(asked, allowMissingColumns=True)
        .groupBy(key, "_bucket")
        .agg(F.first("_fact", ignorenulls=True).alias("_fact"), F.max("_asked").alias("_asked"))
    )
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    openings = timeline.withColumn("_fact", F.last("_fact", ignorenulls=True).over(before)).filter(
        F.col("_asked") & F.col("_fact").isNotNull()
    )
    rows = (
        f.withColumn("_rank", F.lit(1))
        .unionByName(openings.drop("_asked").withColumn("_rank", F.lit(0)), allowMissingColumns=True)
        .unionByName(p.withColumn("_rank", F.lit(2)), allowMissingColumns=True)
    )
    # The opening row has no time and sorts first; at equal times facts come before probes.
    inside = (
        W.partitionBy(key, "_bucket")
        .orderBy(F.col("_t").asc_nulls_first(), "_rank", "_id")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        rows.withColumn("_fact", F.last("_fact", ignorenulls=True).over(inside))
        .filter(F.col("_rank") == 2)
        .select(key, "_probe.*", "_fact.*")
    )


def facts_between(facts: DataFrame, key: str, fact_time: str, fact_id: str, first: int, last: int) -> DataFrame:
    """The facts that ``as_of`` needs for probes from ``first`` to ``last`` (microseconds, both included): those of that time
    and each key's last one before it."""
    at = clock.micros(F.col(fact_time))
    earlier = facts.filter((at < first) & F.col(key).isNotNull())
    closing = earlier.groupBy(key).agg(F.max_by(F.struct(*facts.columns), F.struct(fact_time, fact_id)).alias("_row"))
    return closing.select("_row.*").unionByName(facts.filter(at.between(first, last)))


def _cell(x: Column, level: Column, grid: GridParams) -> Column:
    return F.floor(x / (F.lit(grid.base_degrees) * F.pow(F.lit(2.0), level)))


def boxes_with_points(
    boxes: DataFrame,
    points: DataFrame,
    moment: str,
    valid_from: str,
    valid_to: str,
    grid: GridParams = GRID,
) -> DataFrame:
    """Pairs of box and point where the point lies in the box (edges included) and is valid at the box's moment.

    Boxes carry ``south, west, north, east``, points ``lat, lng``. The join is an equi-join on (grid level,
    cell, time rung, time bucket) with the exact test as residual:

    * a box uses the one grid level on which it spans few cells, a point is listed on every level, so large
      boxes do not explode into many cells;
    * a point's validity uses the one time rung on which it spans few buckets, a box is listed on every
      rung that some point uses (a scalar subquery of a few values), so a busy cell is split by time;
    * a point without a known end, or valid for longer than two of the widest buckets, stands on a rung of its own
      that has one bucket, so it is listed once per cell.

    Box and point agree on at most one key, so no pair appears twice. The pairs are the result: where boxes and points
    both grow in one area and time, it grows with their product.
    """
    top = grid.levels - 1
    span = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    ratio = span / F.lit(grid.base_degrees * grid.cells_per_axis)
    level = F.when(ratio <= 1, F.lit(0)).otherwise(F.least(F.lit(top), F.ceil(F.log2(ratio)).cast("int")))
    valid = valid_points(points, valid_from, valid_to, grid)

    def cells(low: str, high: str) -> Column:
        level_ = F.col("_level")
        return F.explode(F.sequence(_cell(F.col(low), level_, grid), _cell(F.col(high), level_, grid)))

    box_rows = (
        boxes_by_time(boxes.filter(F.col("south").isNotNull()).withColumn("_level", level), valid, moment, grid)
        .withColumn("_x", cells("south", "north"))
        .withColumn("_y", cells("west", "east"))
    )
    point_rows = (
        points_by_time(valid, valid_from, valid_to, grid)
        .withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top))))
        .withColumn("_x", _cell(F.col("lat"), F.col("_level"), grid))
        .withColumn("_y", _cell(F.col("lng"), F.col("_level"), grid))
    )
    on_key = ["_level", "_x", "_y", "_rung", "_bucket"]
    # Estimates know nothing of the rows listed above, so without the hint they could be broadcast through the driver.
    return box_rows.join(point_rows.hint("merge"), on_key).filter(is_inside(moment, valid_from, valid_to)).drop(*on_key)


def is_inside(moment: str, valid_from: str, valid_to: str) -> Column:
    """Whether the point lies in the box, edges included, and is valid at the box's moment."""
    return (
        F.col("lat").between(F.col("south"), F.col("north"))
        & F.col("lng").between(F.col("west"), F.col("east"))
        & (F.col(valid_from) <= F.col(moment))
        & (F.col(valid_to).isNull() | (F.col(moment) < F.col(valid_to)))
    )


def valid_points(points: DataFrame, valid_from: str, valid_to: str, grid: GridParams = GRID) -> DataFrame:
    """Points that are valid at some time, each with the time rung (``_rung``) on which it spans few buckets; those
    without a known end, or valid for longer than two of the widest buckets, stand on a rung of their own."""
    minutes = (F.col(valid_to) - F.col(valid_from)).cast("interval minute").cast("bigint")
    last = len(grid.time_rungs_minutes) - 1
    rung = F.when(minutes <= 2 * grid.time_rungs_minutes[last], F.lit(last)).otherwise(F.lit(last + 1))
    for i in range(last - 1, -1, -1):
        rung = F.when(minutes <= grid.time_rungs_minutes[i], F.lit(i)).otherwise(rung)
    has_time = F.col(valid_to).isNull() | (F.col(valid_to) > F.col(valid_from))
    return points.filter(F.col(valid_from).isNotNull() & has_time).withColumn("_rung", rung)


def points_between(points: DataFrame, valid_from: str, valid_to: str, first: int, last: int) -> DataFrame:
    """Points valid at some moment from ``first`` to ``last`` (microseconds, both included)."""
    ends = F.col(valid_to).isNull() | (clock.micros(F.col(valid_to)) > first)
    return points.filter((clock.micros(F.col(valid_from)) <= last) & ends)


def boxes_by_time(boxes: DataFrame, valid: DataFrame, moment: str, grid: GridParams = GRID) -> DataFrame:
    """Boxes once per rung that some point uses, with the bucket of their moment there."""
    open_rung = len(grid.time_rungs_minutes)
    rungs = F.array(
        *[
            F.struct(F.lit(i).alias("_rung"), clock.minute_bucket(F.col(moment), m).alias("_bucket"))
            for i, m in enumerate(grid.time_rungs_minutes)
        ],
        F.struct(F.lit(open_rung).alias("_rung"), F.lit(0).cast("bigint").alias("_bucket")),
    )
    used = valid.agg(F.collect_set("_rung").alias("used")).scalar()
    listed = F.inline(F.filter(rungs, lambda r: F.array_contains("_used", r["_rung"])))
    return boxes.withColumn("_used", used).select("*", listed).drop("_used")


def points_by_time(valid: DataFrame, valid_from: str, valid_to: str, grid: GridParams = GRID) -> DataFrame:
    """Valid points once per bucket of their rung that they are valid in."""

    def buckets(edge: str) -> Column:
        value = F.lit(0).cast("bigint")
        for i in range(len(grid.time_rungs_minutes) - 1, -1, -1):
            value = F.when(F.col("_rung") == i, clock.minute_bucket(F.col(edge), grid.time_rungs_minutes[i])).otherwise(value)
        return value

    return valid.withColumn("_bucket", F.explode(F.sequence(buckets(valid_from), buckets(valid_to))))


def degrees_apart(lat: Column, lng: Column, other_lat: Column, other_lng: Column) -> Column:
    """Distance in degrees of latitude over a flat earth around the first point, to nine places."""
    across = (other_lng - lng) * F.cos(F.radians(lat))
    return F.round(F.sqrt(F.pow(other_lat - lat, F.lit(2)) + F.pow(across, F.lit(2))), 9)


def nearest(points: DataFrame, places: DataFrame, point_id: str, place_id: str, grid: NearGridParams = NEAR_GRID) -> DataFrame:
    """Each point with the id of the place nearest to it by ``degrees_apart`` (``degrees``), the smallest id among equals.

    Both have ``lat, lng``. Points and places lie on grids of cells that double in size. A point first finds the finest
    grid on which the nine cells around it hold any place; that place is at most 2.9 cells away, so the nearest one lies
    in the nine cells of a grid with cells of that size, wider still where meridians lie close. The first step joins the
    points' distinct finest cells with the occupied cells only, the second points with places; all are equi-joins, and
    places at one spot count as one.

    Points without a coordinate, or within a degree of a pole, and points of an empty table of places get nulls; the date
    line is not crossed. ``point_id`` is unique.
    """
    spots = places.filter("lat IS NOT NULL AND lng IS NOT NULL").groupBy("lat", "lng").agg(F.min(place_id).alias("_place"))
    levels = F.sequence(F.lit(0), F.lit(grid.levels - 1))

    def cell(x: str) -> Column:
        # Doubling is exact, so a cell lies in one cell of every wider grid.
        return F.floor(F.col(x) / (F.lit(grid.cell_degrees) * F.pow(F.lit(2.0), F.col("_level")))).cast("bigint")

    def on_levels(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_level", F.explode(levels)).withColumns({"_x": cell("lat"), "_y": cell("lng")})

    def around(frame: DataFrame) -> DataFrame:
        sides = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        near = frame.select("*", F.inline(sides))
        return near.withColumns({"_x": cell("lat") + F.col("_i"), "_y": cell("lng") + F.col("_j")}).drop("_i", "_j")

    key = ["_level", "_x", "_y"]
    located = points.filter(F.abs("lat") < 89).filter(F.col("lng").isNotNull()).select(point_id, "lat", "lng")
    # Which grid is the finest follows from a point's finest cell alone, so it is asked once per cell, and occupied cells
    # are widened by their neighbours rather than cells of points.
    fine = located.withColumns({"_level": F.lit(0)}).withColumns({"_fx": cell("lat"), "_fy": cell("lng")}).drop("_level")
    asked = fine.select("_fx", "_fy").distinct().withColumn("_level", F.explode(levels))
    asked = asked.withColumns({"_x": F.expr("shiftright(_fx, _level)"), "_y": F.expr("shiftright(_fy, _level)")})
    sides = F.array(*[F.struct((F.col("_x") + i).alias("_x"), (F.col("_y") + j).alias("_y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    occupied = on_levels(spots).select(*key).distinct().select("_level", F.inline(sides)).distinct()
    levels_found = asked.join(occupied.hint("merge"), key).groupBy("_fx", "_fy").agg(F.min("_level").alias("_level"))
    finest = fine.join(levels_found, ["_fx", "_fy"]).drop("_fx", "_fy")
    narrow = F.ceil(-F.log2(F.cos(F.radians("lat")))).cast("int")
    reach = F.lit(2.9 * grid.cell_degrees) * F.pow(F.lit(2.0), F.col("_level"))
    wide = finest.withColumn("_reach", reach).withColumn("_level", F.least(F.col("_level") + 2 + narrow, F.lit(grid.levels - 1)))
    listed = on_levels(spots.withColumnsRenamed({"lat": "_lat", "lng": "_lng"}).withColumns({"lat": F.col("_lat"), "lng": F.col("_lng")})).drop("lat", "lng")
    # Places out of reach are left before distances are ordered: those nine cells are much wider than the reach.
    across = F.abs(F.col("_lng") - F.col("lng")) * F.cos(F.radians("lat"))
    is_near = (F.abs(F.col("_lat") - F.col("lat")) <= F.col("_reach")) & (across <= F.col("_reach"))
    pairs = around(wide).join(listed.hint("merge"), key).filter(is_near)
    apart = degrees_apart(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    best = pairs.groupBy(point_id).agg(F.min(F.struct(apart.alias("degrees"), "_place")).alias("_best"))
    found = best.select(point_id, F.col("_best._place").alias(place_id), "_best.degrees")
    return points.join(found, point_id, "left")
