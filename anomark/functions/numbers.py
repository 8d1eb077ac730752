"""Numbers read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(value: Column) -> Column:
    """True for numbers that are neither infinite nor NaN, false for these and for null."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def finite_double(text: Column) -> Column:
    """The text as a double; null if it is no number or stands for an infinite or undefined one."""
    number = text.try_cast("double")
    return F.when(is_finite(number), number)
