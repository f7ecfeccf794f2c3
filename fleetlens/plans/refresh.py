"""The daily jobs: everything for all sensors, written to shared storage.

Each step reads the tables an earlier step has written, not its plan: a lost executor repeats one step's tasks. A run
has a folder of its own and is published when all of it is stored (``sinks.runs``), so that a stopped run changes
nothing for readers and leaves nothing behind that a later run would meet. ``backfill`` runs what is not yet published.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import day_start
from fleetlens.functions.times import Moment
from fleetlens.operators import anomaly, cohort
from fleetlens.operators.enriched import enriched_daily_series
from fleetlens.plans.reports import DATASETS, cohort_report
from fleetlens.sinks import new_run, publish, read_dataset, unpublished, write_csv, write_dataset
from fleetlens.sources.catalogue import catalogue_frame
from fleetlens.sources.tables import Fleet

REPORT_DAYS = 30
ANOMALY_DAYS = 365


def store_dataset(df: DataFrame, folder: str, name: str) -> DataFrame:
    write_dataset(df, folder, name)
    return read_dataset(df.sparkSession, folder, name, df.schema)


def write_silent(catalogue: DataFrame, machines: DataFrame, folder: str) -> None:
    silent = cohort.silent_sensors(catalogue, machines)
    write_dataset(silent.withColumn("silent", F.lit(True)), folder, "silent_sensors")


def write_report(
    fleet: Fleet,
    catalogue: DataFrame,
    results: DataFrame,
    folder: str,
    start: date,
    end: date,
    as_of: Moment,
    ready: Callable[[DataFrame], dict[str, DataFrame]] | None = None,
) -> None:
    """All datasets that follow from stored results. ``ready`` makes some of them from the stored cohort in another way."""
    write_dataset(cohort.timeline(results), folder, "timeline")
    machines = store_dataset(cohort.cohort(results), folder, "cohort")
    machines = machines.join(catalogue.select("sensor"), "sensor", "left_semi")
    datasets = ready(machines) if ready else {}
    datasets |= cohort_report(fleet, machines, start, end, as_of, [name for name in DATASETS if name not in datasets])
    for name, dataset in datasets.items():
        write_dataset(dataset, folder, name)
    write_silent(catalogue, machines, folder)


def daily_refresh(fleet: Fleet, sensors: Sequence[str], root: str, as_of: Moment, *, whole: bool = True) -> str:
    """Writes the 30-day report of all sensors: results, timeline, all report datasets, silent sensors.

    Returns the name of the run. A ``whole`` run ends what earlier ones hold of sensors that are not listed any more.
    """
    start, end = day_start(as_of, -REPORT_DAYS).date(), day_start(as_of).date()
    catalogue = catalogue_frame(fleet.spark, sensors)
    run, folder = new_run(root, as_of)
    results = store_dataset(cohort.sensor_results(fleet, start, end, sensors), folder, "results")
    write_report(fleet, catalogue, results, folder, start, end, as_of)
    publish(catalogue, root, run, as_of, whole=whole)
    return run


def backfill(fleet: Fleet, sensors: Sequence[str], root: str, as_of: Moment) -> list[str]:
    """Runs ``daily_refresh`` for the sensors that no published run of this day or later holds; returns their names."""
    targets = unpublished(catalogue_frame(fleet.spark, sensors), root, as_of)
    # Names of the catalogue, which the caller passed in; not data.
    missing = sorted(row.sensor for row in targets.collect())
    if missing:
        daily_refresh(fleet, missing, root, as_of, whole=False)
    return missing


def anomaly_refresh(fleet: Fleet, sensors: Sequence[str], root: str, as_of: Moment) -> str:
    """Writes one year of series with anomalies, and the report of the anomalous days.

    The anomalous days are also written as a CSV file with one column per sensor that has any, the comparison
    of the last two weeks as ``snapshot`` and the last week's systems as the CSV file ``last_week``, all in the folder of
    the run, whose name is returned.
    """
    start, end = day_start(as_of, -ANOMALY_DAYS).date(), day_start(as_of).date()
    run, folder = new_run(root, as_of)
    series = enriched_daily_series(fleet, start, end, sensors)
    points = store_dataset(anomaly.trend_anomalies(series), folder, "points")
    days = anomaly.anomaly_days(points)
    # At most the sensors that the caller named.
    flagged = sorted(row.sensor for row in days.select("sensor").distinct().collect())
    write_csv(anomaly.anomaly_days_wide(days, flagged).orderBy("position"), f"{folder}/anomaly_days")
    write_dataset(anomaly.anomaly_snapshot(points, as_of), folder, "snapshot")
    every = cohort.sensor_results(fleet, start, end, sensors, pair_keys=("wguid", "resulttime"))
    results = store_dataset(cohort.on_days(every, days), folder, "results")
    write_csv(cohort.system_ids(cohort.last_week(results, as_of)), f"{folder}/last_week")
    write_dataset(cohort.timeline(results), folder, "timeline")
    ranged = store_dataset(anomaly.ranged_cohort(cohort.cohort(results), days), folder, "cohort")
    earliest = day_start(as_of, -ANOMALY_DAYS - anomaly.LOOKBACK_DAYS).date()
    for name, dataset in cohort_report(fleet, ranged, earliest, end, as_of).items():
        write_dataset(dataset, folder, name)
    silent = days.select(F.col("sensor")).distinct()
    write_silent(silent, ranged, folder)
    publish(catalogue_frame(fleet.spark, sensors), root, run, as_of)
    return run
