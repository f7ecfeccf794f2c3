"""Numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category names in ascending order, with the upper edge of each (right-closed) bin.
HEALTH_CATEGORIES = (("Poor", 80.0), ("Fair", 90.0), ("Good", 97.0), ("Excellent", float("inf")))


def health_category(score: str | Column) -> Column:
    """Bin of a mean health score. A score of 0 or less has no category."""
    value = F.col(score) if isinstance(score, str) else score
    label = F.when(value <= 0, F.lit(None).cast("string"))
    for name, edge in HEALTH_CATEGORIES:
        label = label.when(value <= edge, F.lit(name))
    return label


def exact_score(score: Column) -> Column:
    """A score to 12 decimals, as sums of decimals do not depend on the order of the rows.

    NULL where that is not the score: NaN, infinite, 10^18 and more, or next to nothing.
    """
    exact = score.try_cast("decimal(30,12)")
    return F.when(F.abs(exact.cast("double") - score) <= 1e-9 * F.abs(score), exact)


def score_sums(score: Column) -> dict[str, Column]:
    """What a mean score is made of: the sum and number of all scores, and of those with an exact decimal."""
    exact = exact_score(score)
    return {"total": F.sum(score), "n": F.count(score), "exact": F.sum(exact), "n_exact": F.count(exact)}


def mean_score(sums: dict[str, Column]) -> Column:
    """The mean of ``score_sums``: a mean on the edge of a category stays on it, in whatever order its rows are added.

    Doubles are added where a score has no decimal (``exact_score``).
    """
    total = F.when(sums["n_exact"] == sums["n"], sums["exact"].cast("double")).otherwise(sums["total"])
    return F.try_divide(total, sums["n"])


def percentage(part: Column, whole: Column) -> Column:
    """Multiplied before it is divided: 7 of 100 is 7, so that a threshold of 7 is not passed."""
    return F.try_divide(part * 100.0, whole)


def percent_change(current: Column, previous: Column) -> Column:
    """Change in whole percent, half to even.

    A rise from nothing counts as 100; nothing to nothing has no change (NULL).
    """
    change = F.bround(F.try_divide(current - previous, previous) * 100.0, 0)
    return F.when((previous == 0) & (current != 0), F.lit(100.0)).otherwise(change).cast("long")
