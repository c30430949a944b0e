"""JSON columns: key presence, polymorphic values, typed parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commutelens.schemas import CORRUPT


def parse(text: Column, schema: T.StructType) -> Column:
    """Typed value of JSON text; the schema's corrupt-record field keeps text that does not parse."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def with_parsed(df: DataFrame, text: str, schema: T.StructType, name: str) -> DataFrame:
    """Adds the typed value of a JSON column, parsed once per row.

    A plain projection would be merged into every later filter and field access and parse the text again for
    each; a one-element generator keeps it in one place.
    """
    return df.select("*", F.explode(F.array(parse(F.col(text), schema))).alias(name))


def with_variant(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds a JSON column as a variant, parsed once per row: every field stays, whatever its type, and is read by path
    where it is asked for. Text that does not parse becomes null."""
    return df.select("*", F.explode(F.array(F.try_parse_json(text))).alias(name))


def at_path(value: Column, path: str, kind: str) -> Column:
    """The field of a variant at a path, null where it is absent or of another type."""
    return F.try_variant_get(value, path, kind)


def absent_keys(text: Column, required: tuple[str, ...]) -> Column:
    """Required keys that the JSON object lacks, in the order given; a key set to null is present."""
    wanted = F.array(*[F.lit(k) for k in required])
    return F.array_except(wanted, F.json_object_keys(text))


def unwrap_number(text: Column) -> Column:
    """The number in a bare number, in an object's ``prediction`` or in the first item of a list."""
    return F.coalesce(
        text.try_cast("double"),
        F.get_json_object(text, "$.prediction").try_cast("double"),
        F.get_json_object(text, "$[0]").try_cast("double"),
    )
