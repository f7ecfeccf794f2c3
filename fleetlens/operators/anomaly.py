"""Days on which a sensor's trend is abnormal, and how the last week compares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import day_start, percent_change
from fleetlens.functions.times import Moment
from fleetlens.operators.forest import SAMPLE, is_anomaly
from fleetlens.operators.timeseries import MIN_POINTS, PERIOD, long_enough, sigma_band, trend

LOOKBACK_DAYS = 7


def _label_sensor(series: pd.DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    series = series.sort_values("ds", ignore_index=True)
    known = series["trend"].notna()
    series["is_anomaly"] = False
    values = series.loc[known, "trend"].to_numpy()
    series.loc[known, "is_anomaly"] = is_anomaly(values, series["sensor"].iloc[0], sample=sample)
    return series


def trend_anomalies(
    series: DataFrame, *, min_points: int = MIN_POINTS, period: int = PERIOD, sample: int = SAMPLE
) -> DataFrame:
    """``(sensor, ds, y, trend, is_anomaly)`` of all series that are long enough. Rows without a sensor drop out.

    The only step outside the JVM: one small frame per sensor, with one row per day. ``sample`` is how many days
    each tree of the forest is grown on; every day is rated.
    """
    smooth = trend(long_enough(series, min_points), period)
    smooth = smooth.select("sensor", "ds", F.col("y").cast("long").alias("y"), "trend").filter(F.col("sensor").isNotNull())
    return smooth.groupBy("sensor").applyInPandas(
        partial(_label_sensor, sample=sample), "sensor string, ds date, y long, trend double, is_anomaly boolean"
    )


def sigma_anomalies(series: DataFrame, *, sigmas: float = 3.0, min_points: int = MIN_POINTS) -> DataFrame:
    """As ``trend_anomalies``, with the sigma band of the trend in place of the forest."""
    smooth = trend(long_enough(series, min_points))
    band = sigma_band(smooth, sigmas, "trend").select("sensor", "lower", "upper")
    outside = (F.col("trend") < F.col("lower")) | (F.col("trend") > F.col("upper"))
    flagged = smooth.join(band, "sensor").withColumn("is_anomaly", F.coalesce(outside, F.lit(False)))
    return flagged.select("sensor", "ds", F.col("y").cast("long").alias("y"), "trend", "is_anomaly")


def anomaly_days(points: DataFrame) -> DataFrame:
    """``(sensor, anomaly_date)`` of the flagged rows."""
    return points.filter("is_anomaly").select("sensor", F.col("ds").alias("anomaly_date"))


def anomaly_bounds(days: DataFrame) -> DataFrame:
    """First and last anomalous day per sensor."""
    return days.groupBy("sensor").agg(
        F.min("anomaly_date").alias("first_date"), F.max("anomaly_date").alias("last_date")
    )


def ranged_cohort(cohort: DataFrame, days: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """The cohort with every sensor's own range: a week before its first anomalous day to its last."""
    ranges = anomaly_bounds(days).select(
        "sensor",
        F.date_sub("first_date", lookback_days).alias("date_from"),
        F.col("last_date").alias("date_to"),
    )
    return cohort.join(ranges, "sensor")


def anomaly_days_wide(days: DataFrame, sensors: Sequence[str] | None = None) -> DataFrame:
    """One column per sensor with its days in order, for export. Columns: ``position`` and the sensors.

    Without a list, the sensors that have any anomalous day.
    """
    in_order = Window.partitionBy("sensor").orderBy("anomaly_date")
    placed = days.withColumn("position", F.row_number().over(in_order))
    by_position = placed.groupBy("position")
    wide = by_position.pivot("sensor", list(sensors)) if sensors is not None else by_position.pivot("sensor")
    return wide.agg(F.first("anomaly_date"))


def anomaly_snapshot(points: DataFrame, as_of: Moment) -> DataFrame:
    """Trend sums of the anomalous days in the last week, the change to the week before, and the rank.

    The last week has no upper bound. Sensors without change (nothing in both weeks) come last.
    The rank is over one row per sensor.
    """
    week, fortnight = (F.lit(str(day_start(as_of, -d).date())).cast("date") for d in (7, 14))
    ds, flagged = F.col("ds"), points.filter("is_anomaly")
    sums = flagged.groupBy("sensor").agg(
        F.coalesce(F.sum(F.when(ds >= week, F.col("trend"))), F.lit(0.0)).alias("current"),
        F.coalesce(F.sum(F.when((ds >= fortnight) & (ds < week), F.col("trend"))), F.lit(0.0)).alias("previous"),
    )
    changes = sums.select(
        "sensor",
        F.bround("current", 0).cast("long").alias("trend_sum"),
        percent_change(F.col("current"), F.col("previous")).alias("pct_change"),
    )
    order = Window.orderBy(F.desc_nulls_last("pct_change"), "sensor")
    return changes.withColumn("rank", F.row_number().over(order))
