"""Time predicates that stay visible to the scan."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = str | date | datetime


def moment(value: Moment) -> datetime:
    """The value as a timestamp; a plain date means its first instant."""
    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def day_start(value: Moment, days: int = 0) -> datetime:
    """Midnight of the value's day, moved by whole days."""
    at = moment(value)
    return datetime(at.year, at.month, at.day) + timedelta(days=days)


def in_range(
    df: DataFrame,
    column: str,
    start: Moment | None = None,
    end: Moment | None = None,
    *,
    lower_inclusive: bool = True,
    upper_inclusive: bool = True,
) -> DataFrame:
    """Rows of the time range.

    An upper date stands for its midnight: later times of that day are out. The bounds are
    cast to the column's own type, so the comparison is pushed to the scan.
    """
    kind = df.schema[column].dataType
    value = F.col(column)
    if start is not None:
        low = F.lit(str(start)).cast(kind)
        df = df.filter(value >= low if lower_inclusive else value > low)
    if end is not None:
        high = F.lit(str(end)).cast(kind)
        df = df.filter(value <= high if upper_inclusive else value < high)
    return df


def is_workday(day: str | Column) -> Column:
    """Monday to Friday (``weekday`` counts Monday as 0; ``dayofweek`` would start on Sunday)."""
    return F.weekday(day) < 5
