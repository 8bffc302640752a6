"""Rounding of doubles as the reference's arrays and printf do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, places: int) -> Column:
    """A double rounded half-even at its scaled value, as numpy and SQL's round_even do; `bround` rounds its decimal text."""
    scale = float(10 ** places)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def three_places(value: Column) -> Column:
    """A non-negative number with three decimals, rounded by its exact binary value as in printf('%.3f').

    Twice the scaled value is compared with the odd number between two results. The value's first 24 bits and its
    other 29 are multiplied apart, so that both products are exact.
    """
    low = F.floor(value * 1000.0)
    head = value.cast("float").cast("double")
    beyond = (head * 2000.0 - (low * 2.0 + 1.0)) + (value - head) * 2000.0
    up = (beyond > 0) | ((beyond == 0) & (low % 2 == 1))
    text = ((low + F.when(up, 1).otherwise(0)) / 1000.0).cast("decimal(18,3)").cast("string")
    return F.when(value >= 1e12, F.format_string("%.3f", value)).otherwise(text)
