"""Guarded statistical expressions: NULL instead of an error when a spread is zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def zscore(value: Column, mean: float | None, std: float | None) -> Column:
    return F.try_divide(value - F.lit(mean).cast("double"), F.lit(std).cast("double"))
