"""The yearly sensor input: raw and derived results with machine and sensor details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import in_range
from fleetlens.functions.times import Moment
from fleetlens.sources.tables import Fleet

ABOVE_SEVERITY = 4
_SOURCES = (("sensor_results_raw", "systemid"), ("derived_sensors", "sensorsystemid"))


def yearly_results(
    fleet: Fleet,
    start: Moment,
    end: Moment,
    sensors: Sequence[str] | None = None,
) -> DataFrame:
    """Raw and derived results (duplicates kept), strictly between the bounds, above severity 4."""
    parts = []
    for table, system_id in _SOURCES:
        rows = in_range(
            fleet[table], "resulttime", start, end, lower_inclusive=False, upper_inclusive=False
        )
        rows = rows.filter((F.col("severity") > ABOVE_SEVERITY) & ~F.col(system_id).like("V%"))
        if sensors is not None:
            rows = rows.filter(F.col("sensorname").isin(list(sensors)))
        parts.append(
            rows.select(
                "wguid",
                F.col(system_id).alias("systemid"),
                F.col("sensorname").alias("sensor"),
                "severity",
                "resulttime",
                "instancevalue",
                "sensorid",
            )
        )
    return parts[0].unionByName(parts[1])


def _details(fleet: Fleet, dedupe: bool) -> tuple[DataFrame, DataFrame]:
    config = fleet["system_config"].select(
        "wguid",
        F.col("systemid").alias("sconfig_systemid"),
        (F.col("totalphysicalmemory") / F.lit(1e7)).alias("memory_1e7"),
        "model",
    )
    info = fleet["sensor_information"].select(
        F.col("ruleid").alias("sensorid"), "sensorcategory", "description"
    )
    return (_one_per(config, "wguid"), _one_per(info, "sensorid")) if dedupe else (config, info)


def _one_per(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("first"))
    return first.select(key, *[f"first.{c}" for c in rest])


def sensor_enriched(
    fleet: Fleet,
    start: Moment,
    end: Moment,
    sensors: Sequence[str] | None = None,
    *,
    dedupe_dimensions: bool = False,
) -> DataFrame:
    """Yearly results with configuration and sensor information.

    Repeated configuration or information rows repeat the results, unless ``dedupe_dimensions``.
    """
    config, info = _details(fleet, dedupe_dimensions)
    rows = yearly_results(fleet, start, end, sensors)
    return rows.join(config, "wguid", "left").join(info, "sensorid", "left").select(
        "wguid",
        "systemid",
        "sensor",
        "severity",
        "resulttime",
        "instancevalue",
        "sconfig_systemid",
        "memory_1e7",
        "model",
        "sensorcategory",
        "description",
    )


def enriched_daily_series(
    fleet: Fleet,
    start: Moment,
    end: Moment,
    sensors: Sequence[str] | None = None,
    *,
    dedupe_dimensions: bool = False,
) -> DataFrame:
    """``daily_series`` of ``sensor_enriched`` without building its rows: ``(sensor, ds, y)``.

    Results are counted per day, machine and rule first; repeated dimension rows enter as factors.
    """
    rows = yearly_results(fleet, start, end, sensors)
    day = F.to_date("resulttime").alias("ds")
    if dedupe_dimensions:
        return rows.groupBy("sensor", day).agg(F.count(F.lit(1)).alias("y"))
    counted = rows.groupBy("sensor", day, "wguid", "sensorid").agg(F.count(F.lit(1)).alias("n"))
    configs = fleet["system_config"].groupBy("wguid").agg(F.count(F.lit(1)).alias("n_configs"))
    infos = fleet["sensor_information"].groupBy(F.col("ruleid").alias("sensorid"))
    infos = infos.agg(F.count(F.lit(1)).alias("n_infos"))
    factor = F.coalesce("n_configs", F.lit(1)) * F.coalesce("n_infos", F.lit(1))
    joined = counted.join(configs, "wguid", "left").join(infos, "sensorid", "left")
    return joined.groupBy("sensor", "ds").agg(F.sum(F.col("n") * factor).alias("y"))
