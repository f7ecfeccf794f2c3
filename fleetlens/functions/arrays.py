"""Lookups in sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHORT = 16  # arrays up to here are counted through
_STEPS = [1 << k for k in range(15, -1, -1)]  # up to 65,535 numbers: both halves of the days of 89 years


def count_upto(numbers: Column, most: Column) -> Column:
    """How many numbers of a sorted array are at most ``most``: by binary search, where it is not short."""
    steps = F.array(*[F.lit(step) for step in _STEPS])
    searched = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(numbers, at + step - 1) <= most, at + step).otherwise(at)
    )
    return F.when(F.size(numbers) <= _SHORT, F.size(F.filter(numbers, lambda x: x <= most))).otherwise(searched)
