"""Which machines raised a sensor, and when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import day_start, host_name, in_range, is_pair, is_workday, user_name
from fleetlens.functions.times import Moment
from fleetlens.operators.cosensor import PAIR_KEYS, cosensor_results
from fleetlens.sources.catalogue import pair_members
from fleetlens.sources.tables import Fleet

MIN_SEVERITY = 8
_RESULT_COLUMNS = ("sensor", "wguid", "sensorsystemid", "resulttime", "resultdate")


def daily_results(
    fleet: Fleet,
    start: Moment | None = None,
    end: Moment | None = None,
    sensors: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of the daily results table as ``(sensor, wguid, sensorsystemid, resulttime, resultdate)``."""
    rows = in_range(fleet["sensor_results_daily"], "resulttime", start, end)
    if sensors is not None:
        rows = rows.filter(F.col("sensorname").isin(list(sensors)))
    return rows.select(
        F.col("sensorname").alias("sensor"),
        "wguid",
        "sensorsystemid",
        "resulttime",
        F.to_date("resulttime").alias("resultdate"),
    )


def raw_results(
    fleet: Fleet,
    start: Moment | None = None,
    end: Moment | None = None,
    sensors: Sequence[str] | None = None,
) -> DataFrame:
    """Severe rows of the raw results table, without virtual systems (ids that start with ``V``)."""
    rows = in_range(fleet["sensor_results_raw"], "resulttime", start, end)
    rows = rows.filter((F.col("severity") >= MIN_SEVERITY) & ~F.col("systemid").like("V%"))
    if sensors is not None:
        rows = rows.filter(F.col("sensorname").isin(list(sensors)))
    return rows.select(
        F.col("sensorname").alias("sensor"),
        "wguid",
        F.col("systemid").alias("sensorsystemid"),
        "resulttime",
        F.to_date("resulttime").alias("resultdate"),
    )


def sensor_results(
    fleet: Fleet,
    start: Moment | None,
    end: Moment | None,
    sensors: Sequence[str] | None = None,
    *,
    pair_keys: Sequence[str] = PAIR_KEYS,
) -> DataFrame:
    """Result rows of all wanted sensors in one frame; names written ``A:B`` are pairs.

    Without a sensor list: every single sensor of the daily table.
    """
    if sensors is None:
        return daily_results(fleet, start, end)
    singles = [s for s in sensors if not is_pair(s)]
    pairs = [s for s in sensors if is_pair(s)]
    parts = []
    if singles or not pairs:
        parts.append(daily_results(fleet, start, end, singles))
    if pairs:
        raw = raw_results(fleet, start, end, pair_members(pairs))
        paired = cosensor_results(raw, pairs, keys=pair_keys)
        if "sensorsystemid" not in paired.columns:
            kind = raw.schema["sensorsystemid"].dataType
            paired = paired.withColumn("sensorsystemid", F.lit(None).cast(kind))
        parts.append(paired.withColumn("resultdate", F.to_date("resulttime")).select(*_RESULT_COLUMNS))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def on_days(results: DataFrame, days: DataFrame) -> DataFrame:
    """Result rows that fall on the listed days: ``days`` holds ``(sensor, anomaly_date)``."""
    wanted = days.select("sensor", F.col("anomaly_date").alias("resultdate")).distinct()
    return results.join(wanted, ["sensor", "resultdate"], "left_semi").select(*results.columns)


def cohort(results: DataFrame) -> DataFrame:
    """Distinct machines per sensor, weekends included: ``(sensor, wguid)``."""
    return results.filter(F.col("wguid").isNotNull()).select("sensor", "wguid").distinct()


def cohort_size(cohort_rows: DataFrame) -> DataFrame:
    """Number of machines per sensor of a cohort."""
    return cohort_rows.groupBy("sensor").agg(F.count(F.lit(1)).alias("machines"))


def timeline(results: DataFrame) -> DataFrame:
    """Result rows per sensor and workday."""
    days = results.filter(is_workday("resultdate")).groupBy("sensor", F.col("resultdate").alias("date"))
    return days.agg(F.count(F.lit(1)).alias("count"))


def with_day_label(days: DataFrame) -> DataFrame:
    """Adds the day as display text, such as ``Jan 05 2024``."""
    return days.withColumn("label", F.date_format("date", "MMM dd yyyy"))


def machine_results(
    fleet: Fleet,
    machines: DataFrame,
    start: Moment | None,
    end: Moment | None,
    components: Sequence[str],
) -> DataFrame:
    """Distinct results of the listed machines, from the daily table and the raw pair components."""
    wanted = machines.select("wguid").distinct()
    rows = daily_results(fleet, start, end).unionByName(raw_results(fleet, start, end, components))
    return rows.join(wanted, "wguid", "left_semi").select(*_RESULT_COLUMNS).distinct()


def sensor_breakdown(results: DataFrame) -> DataFrame:
    """Result rows per sensor, weekends included."""
    return results.groupBy("sensor").agg(F.count(F.lit(1)).alias("count"))


def silent_sensors(catalogue: DataFrame, cohort_rows: DataFrame) -> DataFrame:
    """Sensors of the catalogue that no machine raised."""
    return catalogue.select("sensor").join(cohort_rows.select("sensor").distinct(), "sensor", "left_anti")


def machine_lookup(fleet: Fleet, names: DataFrame, *, by: str, domain: str = "", prefix: str = "") -> DataFrame:
    """Machines of an uploaded list of host names (``by="host"``) or user names (``by="user"``)."""
    column, wanted = {
        "host": ("systemid", host_name("name", domain)),
        "user": ("username", user_name("name", prefix)),
    }[by]
    listed = names.select(wanted.alias(column)).distinct()
    return fleet["user_info"].join(listed, column, "left_semi").select("wguid", F.col(column).alias("name"))


def with_description(results: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds the description of the sensor; NULL if the sensor has no definition."""
    lookup = definitions.select(F.col("sensorname").alias("sensor"), "description")
    return results.join(lookup, "sensor", "left")


def last_week(results: DataFrame, as_of: Moment) -> DataFrame:
    """Result rows since the midnight seven days ago; no upper bound."""
    return in_range(results, "resulttime", day_start(as_of, -7))


def system_ids(results: DataFrame, start: Moment | None = None, end: Moment | None = None) -> DataFrame:
    """Export rows of a time range: system id, sensor, time."""
    rows = in_range(results, "resulttime", start, end)
    return rows.select("sensorsystemid", "sensor", F.col("resulttime").alias("date"))
