"""The one place for rounding: decimals are divided as doubles and rounded at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL when whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def out(value: Column, places: int = PLACES) -> Column:
    """A reported figure: double rounded to the common number of places, never minus zero."""
    return F.round(value.cast("double"), places) + F.lit(0.0)
