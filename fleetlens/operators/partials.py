"""What a window of days has to know of the facts, kept by day, so that the window can move without reading them again.

A partial has one row per day, machine and key. ``late`` tells the rows after the day's midnight from those at it, as
an upper bound is a midnight that still belongs to the window. Counts and sums of a window can be moved: what enters is
added, what leaves is taken out. The newest row per key cannot be taken back; it is merged from the days of the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import day_start, latest_per, score_sums
from fleetlens.functions.times import Moment

DAY, LATE = "day", "late"


def by_day(facts: DataFrame, time: str) -> DataFrame:
    """Facts with their day, and whether they are later than its midnight; rows without a time drop out."""
    day = F.to_date(time)
    return facts.where(F.col(time).isNotNull()).withColumns({DAY: day, LATE: F.col(time) > day})


def day_counts(facts: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """``day, late, keys..., n``: rows per day and key. ``keys`` names the machine, too."""
    return by_day(facts, time).groupBy(DAY, LATE, *keys).agg(F.count(F.lit(1)).alias("n"))


def day_sums(facts: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """As ``day_counts``, with ``total``, the sum of a value, ``n``, its number, and the same of its exact decimals."""
    sums = [column.alias(name) for name, column in score_sums(F.col(value)).items()]
    return by_day(facts, time).groupBy(DAY, LATE, *keys).agg(*sums)


def day_newest(facts: DataFrame, keys: Sequence[str], time: str, carry: Sequence[str]) -> DataFrame:
    """``day, late, keys..., time, carry...``: the newest row per day and key; ties as in ``latest_per``."""
    return latest_per(by_day(facts, time), [DAY, LATE, *keys], time, carry)


def _day(value: Moment) -> Column:
    return F.lit(day_start(value).date())


def inside(parts: DataFrame, start: Moment, end: Moment) -> DataFrame:
    """The rows of the days from ``start`` to the midnight of ``end``."""
    return parts.where((F.col(DAY) >= _day(start)) & (F.col(DAY) <= _day(end))).where((F.col(DAY) < _day(end)) | ~F.col(LATE))


def entering(parts: DataFrame, end: Moment, new_end: Moment) -> DataFrame:
    """What a window gains when its end moves from one midnight to a later one."""
    after = (F.col(DAY) > _day(end)) | F.col(LATE)
    return inside(parts, end, new_end).where(after)


def leaving(parts: DataFrame, start: Moment, new_start: Moment) -> DataFrame:
    """What a window loses when its start moves to a later midnight."""
    return parts.where((F.col(DAY) >= _day(start)) & (F.col(DAY) < _day(new_start)))


def merged(parts: DataFrame, keys: Sequence[str], numbers: Sequence[str] = ("n",)) -> DataFrame:
    """``keys..., numbers...`` of all given days together."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers])


def moved(window: DataFrame, gained: DataFrame, lost: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The window with ``gained`` added and ``lost`` taken out; keys that no row is left of are gone.

    Counts are whole numbers, so a window that has been moved for years equals one that was counted anew.
    """
    signed = [df.select(*keys, (F.col("n") * sign).alias("n")) for df, sign in ((window, 1), (gained, 1), (lost, -1))]
    rows = signed[0].unionByName(signed[1]).unionByName(signed[2])
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def merged_newest(parts: DataFrame, keys: Sequence[str], time: str, carry: Sequence[str]) -> DataFrame:
    """The newest row per key of all given days together."""
    return latest_per(parts, keys, time, carry)
