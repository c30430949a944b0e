"""Distances and boxes on latitude/longitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commutelens.params import TRIP


def great_circle_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.round(F.lit(2 * TRIP.earth_radius_miles) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h))), 6)


def bounding_box(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> dict[str, Column]:
    """Box spanned by two points; null as soon as a coordinate is."""
    known = lat1.isNotNull() & lng1.isNotNull() & lat2.isNotNull() & lng2.isNotNull()
    return {
        "south": F.when(known, F.least(lat1, lat2)),
        "west": F.when(known, F.least(lng1, lng2)),
        "north": F.when(known, F.greatest(lat1, lat2)),
        "east": F.when(known, F.greatest(lng1, lng2)),
    }
