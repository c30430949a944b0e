"""Integer conversions whose rounding rules differ from Spark's defaults, and arithmetic hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNUTH_MULTIPLIER = 2654435761


def round_half_up(x: Column) -> Column:
    """Nearest integer with halves going up, also below zero (-2.5 gives -2)."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def toward_zero(x: Column) -> Column:
    return x.cast("bigint")


def downward(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def arithmetic_hash(key: Column, modulus: int) -> Column:
    """Hash of an integer key that any SQL engine can repeat, in 0..modulus-1. The key is reduced first, so that
    no 64-bit key overflows."""
    return F.pmod(F.pmod(key, F.lit(modulus)) * F.lit(KNUTH_MULTIPLIER % modulus), F.lit(modulus))
