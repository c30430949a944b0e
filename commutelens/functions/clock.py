"""Time arithmetic on zone-free timestamps.

A *slot* is a whole number of hours, minutes or days since 1970-01-01. Series operators work on slots, so
steps, gaps and seasonal phases are integer arithmetic and never depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: format of the timestamp text in the hourly files.
AMPM_FORMAT = "MM/dd/yyyy hh:mm:ss a"


def day_slot(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("bigint")


def hour_slot(ts: Column) -> Column:
    return day_slot(ts) * F.lit(24) + F.hour(ts)


def minute_bucket(ts: Column, minutes: int) -> Column:
    """Index of the ``minutes``-wide bucket that holds ``ts``."""
    return F.floor((hour_slot(ts) * F.lit(60) + F.minute(ts)) / F.lit(minutes))


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp, zone-free or not."""
    return F.unix_micros(ts.cast("timestamp"))


def day_of_slot(slot: Column) -> Column:
    return F.date_from_unix_date(slot.cast("int"))


def hour_of_slot(slot: Column) -> Column:
    """Zone-free timestamp at the start of an hour slot."""
    day = F.floor(slot / F.lit(24))
    return day_of_slot(day).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), (slot - day * F.lit(24)).cast("int")
    )


def hour_floor(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def plus_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours from start to end, never below zero; null if either is."""
    whole = (end - start).cast("interval hour").cast("bigint")
    return F.when(whole < 0, F.lit(0).cast("bigint")).otherwise(whole)


def parse_ampm(text: Column) -> Column:
    """12-hour timestamp text to a zone-free timestamp; junk becomes null."""
    return F.try_to_timestamp(text, F.lit(AMPM_FORMAT)).cast("timestamp_ntz")


def parse_day(text: Column) -> Column:
    """Date text, ISO or month/day/year, to a date; junk becomes null."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("MM/dd/yyyy"))
    ).cast("date")


def clock_parts(text: Column) -> tuple[Column, Column]:
    """``HH:MM`` text to (hour, minute); a part that is no number is null."""
    parts = F.split(text, ":")
    return F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")


def resolve_arrival(now: Column, text: Column) -> Column:
    """The next moment after ``now`` whose clock shows ``text``; a time equal to ``now`` rolls to tomorrow."""
    hour, minute = clock_parts(text)
    in_range = hour.between(0, 23) & minute.between(0, 59)
    today = F.to_date(now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)
    rolled = F.when(today <= now, today + F.make_dt_interval(F.lit(1))).otherwise(today)
    return F.when(in_range, rolled)


def iso_utc(ts: Column, zone: str = "UTC") -> Column:
    """Local wall-clock time of ``zone`` as ISO text in UTC with milliseconds."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clock12(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm a")
