"""Daily series per sensor and their trend.

A series has one row per day, so a window over one sensor holds as many rows as there are days
in the range, whatever the number of results behind them. Windows count rows, not calendar days:
a day without results is no row, unless ``fill_gaps`` adds it with 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import in_range
from fleetlens.functions.times import Moment

PERIOD = 7
MIN_POINTS = 14


def daily_series(results: DataFrame, *, time: str = "resulttime", fill_gaps: bool = False) -> DataFrame:
    """Result rows per sensor and day: ``(sensor, ds, y)``. Rows without a sensor or time are no series."""
    known = results.filter(F.col("sensor").isNotNull() & F.col(time).isNotNull())
    series = known.groupBy("sensor", F.to_date(time).alias("ds")).agg(F.count(F.lit(1)).alias("y"))
    return _with_all_days(series) if fill_gaps else series


def _with_all_days(series: DataFrame) -> DataFrame:
    """Each row also stands for the empty days up to the next row."""
    before_next = F.date_sub(F.lead("ds").over(_by_day()), 1)
    spans = series.withColumn("_last", F.coalesce(before_next, "ds"))
    days = spans.select("sensor", F.col("ds").alias("_first"), "y", F.explode(F.sequence("ds", "_last")).alias("ds"))
    return days.select("sensor", "ds", F.when(F.col("ds") == F.col("_first"), F.col("y")).otherwise(0).alias("y"))


def _by_day():
    return Window.partitionBy("sensor").orderBy("ds")


def long_enough(series: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Series with at least so many rows."""
    points = F.count(F.lit(1)).over(Window.partitionBy("sensor"))
    return series.withColumn("_points", points).filter(F.col("_points") >= min_points).drop("_points")


def trend(series: DataFrame, period: int = PERIOD) -> DataFrame:
    """Centred moving average over an odd period; NULL where the window is not full."""
    if period % 2 == 0:
        raise ValueError("the period must be odd")
    half = period // 2
    around = _by_day().rowsBetween(-half, half)
    full = F.count("y").over(around) == period
    return series.withColumn("trend", F.when(full, F.avg("y").over(around)))


def decompose(series: DataFrame, period: int = PERIOD) -> DataFrame:
    """Additive decomposition ``y = trend + seasonal + residual``; phases are row positions.

    The seasonal part is the mean of ``y - trend`` per phase, less the mean of these means.
    """
    per_sensor = Window.partitionBy("sensor")
    phases = trend(series, period).withColumn("_position", F.row_number().over(_by_day()) - 1)
    phases = phases.withColumn("_phase", F.col("_position") % period)
    effect = F.avg(F.col("y") - F.col("trend")).over(Window.partitionBy("sensor", "_phase"))
    phases = phases.withColumn("_effect", effect)
    level = F.avg(F.when(F.col("_position") < period, F.col("_effect"))).over(per_sensor)
    parts = phases.withColumn("seasonal", F.col("_effect") - level)
    residual = F.col("y") - F.col("trend") - F.col("seasonal")
    return parts.select("sensor", "ds", "y", "trend", "seasonal", residual.alias("residual"))


def rolling_stats(series: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing mean and standard deviation over full windows."""
    columns = []
    for size in windows:
        behind = _by_day().rowsBetween(-(size - 1), 0)
        full = F.count("y").over(behind) == size
        columns.append(F.when(full, F.avg("y").over(behind)).alias(f"mean_{size}"))
        columns.append(F.when(full, F.stddev_samp("y").over(behind)).alias(f"std_{size}"))
    return series.select("sensor", "ds", "y", *columns)


def sigma_band(series: DataFrame, sigmas: float = 3.0, value: str = "y") -> DataFrame:
    """Mean, deviation and band per sensor; the lower edge is not below 0."""
    stats = series.groupBy("sensor").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    width = F.col("std") * sigmas
    return stats.select(
        "sensor",
        "mean",
        "std",
        F.greatest(F.col("mean") - width, F.lit(0.0)).alias("lower"),
        (F.col("mean") + width).alias("upper"),
    )


def series_slice(series: DataFrame, start: Moment | None = None, end: Moment | None = None) -> DataFrame:
    """The part of a series between two days, both included."""
    return in_range(series, "ds", start, end)
