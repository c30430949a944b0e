"""Record checks: rules as columns, accept/reject splits and error records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commutelens.functions import jsons
from commutelens.functions.wording import CLOCK24_PATTERN, EMAIL_PATTERN
from commutelens.schemas import CORRUPT, DENSITY_CLASSES, INCENTIVE_KEYS, INCENTIVE_TYPES, INSIGHT, INSIGHT_KEYS


def has_text(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.length(c) > 0, F.lit(False))


def truthy(df: DataFrame, name: str) -> Column:
    """Present and neither zero nor empty."""
    kind, value = df.schema[name].dataType, F.col(name)
    filled = F.length(value) > 0 if isinstance(kind, T.StringType) else value != 0
    return F.coalesce(filled, F.lit(False))


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks. A rule is a column that is true for a good row."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))


def apply_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds the broken rules' names and whether there are none. The rules run once per row (see ``with_parsed``)."""
    checked = df.select("*", F.explode(F.array(broken_rules(rules))).alias("reasons"))
    return checked.withColumn("accepted", F.size("reasons") == 0)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; together they are the input."""
    return (
        checked.filter("accepted").drop("accepted", "reasons"),
        checked.filter(~F.col("accepted")).drop("accepted"),
    )


def request_rules() -> dict[str, Column]:
    return {
        "departure": is_place("request.departure"),
        "destination": is_place("request.destination"),
        "timeToDestination": F.col("request.timeToDestination").rlike(CLOCK24_PATTERN),
    }


def is_place(point: str) -> Column:
    """Both coordinates are there."""
    return F.col(f"{point}.lat").isNotNull() & F.col(f"{point}.lng").isNotNull()


def registration_rules() -> dict[str, Column]:
    return {
        "name": has_text("name"),
        "email": F.col("email").rlike(EMAIL_PATTERN),
        "password": has_text("password"),
        "confirm": has_text("confirm_password"),
        "password_match": F.col("password").eqNullSafe(F.col("confirm_password")),
    }


def login_rules() -> dict[str, Column]:
    return {"email": F.col("email").rlike(EMAIL_PATTERN), "password": has_text("password")}


def enum_rules(density: Column, incentive: Column) -> dict[str, Column]:
    """Closed vocabularies; a missing value is allowed, an unlisted one is not."""
    return {
        "trafficDensity": density.isNull() | density.isin(*DENSITY_CLASSES),
        "incentiveType": incentive.isNull() | incentive.isin(*INCENTIVE_TYPES),
    }


def parse_responses(df: DataFrame, text: str = "response") -> DataFrame:
    """Typed response, or an error where the text is no JSON object."""
    parsed = jsons.with_parsed(df, text, INSIGHT, "insight")
    bad = F.col("insight").isNull() | F.col(f"insight.{CORRUPT}").isNotNull()
    return parsed.withColumn("error", F.when(bad, F.lit("Response is not valid JSON")))


def response_gaps(df: DataFrame, text: str = "response") -> DataFrame:
    """Absent keys of each readable response and of its nested incentive; the row is kept either way."""
    nested = F.get_json_object(text, "$.incentiveDetails")
    return df.withColumn("missing", jsons.absent_keys(F.col(text), INSIGHT_KEYS)).withColumn(
        "missing_incentive", jsons.absent_keys(nested, INCENTIVE_KEYS)
    )


def complete(trips: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose named results are all present and non-zero."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & truthy(trips, c)
    return trips.filter(keep)


def error_record(error: Column, details: Column, payload: Column) -> Column:
    return F.struct(error.alias("error"), details.alias("details"), payload.alias("payload"))
