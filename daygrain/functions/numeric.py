"""Small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def hours(minutes: Column, places: int = 2) -> Column:
    return F.round(minutes / 60, places)


def larger_known(*cols: Column) -> Column:
    """Row-wise maximum that ignores missing values."""
    return F.greatest(*cols)
