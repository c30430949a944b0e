"""Text built for people, and text patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commutelens.functions.money import dollars_text
from commutelens.functions.numeric import round_half_up

# Fixed value: accepted 12-hour clock text.
CLOCK12_PATTERN = r"(?i)^(0?[1-9]|1[0-2]):[0-5][0-9] ?(AM|PM)$"
CLOCK24_PATTERN = r"^([01]?[0-9]|2[0-3]):[0-5]?[0-9]$"
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}$"
MISSING = "N/A"


def is_clock12(text: Column) -> Column:
    return F.coalesce(text.rlike(CLOCK12_PATTERN), F.lit(False))


def shown(value: Column, prefix: str = "", suffix: str = "") -> Column:
    """A value with its unit, or the stand-in for a missing one."""
    return F.coalesce(F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix)), F.lit(MISSING))


def percent_in(text: Column) -> Column:
    """The first whole number in a piece of text."""
    return F.regexp_extract(text, r"\d+", 0).try_cast("bigint")


def ridership_sentence(riders: Column) -> Column:
    """A sentence on the expected load, or nothing where no forecast is known."""
    return F.when(
        riders.isNotNull(),
        F.concat(F.lit(" Around "), round_half_up(riders).cast("string"), F.lit(" riders are expected.")),
    ).otherwise(F.lit(""))


def nudge(minutes: Column, density: Column, savings: Column, riders: Column) -> Column:
    """Message to a rider; null where travel time or traffic class is unknown."""
    return F.concat(
        F.lit("Traffic on this route is "),
        F.lower(density),
        F.lit("; the bus needs about "),
        minutes.cast("string"),
        F.lit(" min"),
        F.when(savings > 0, F.concat(F.lit(" and keeps $"), dollars_text(savings), F.lit(" in your pocket")))
        .otherwise(F.lit("")),
        F.lit("."),
        ridership_sentence(riders),
    )
