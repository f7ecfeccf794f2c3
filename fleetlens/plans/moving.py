"""The daily report by moving its window: the day after reads the facts of the new day only.

Every run keeps, beside its datasets, the counted windows of its day; the partials of single days are kept by day and
shared by all runs. A run takes the windows of the run before, adds the partials of the days since and takes out those
of the days that have left. Rows of days before are taken as they were read: facts that arrive late need ``daily_refresh``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetlens.functions import day_start, in_range, mean_score
from fleetlens.functions.times import Moment
from fleetlens.operators import cohort, health, partials, presence, profile
from fleetlens.plans.refresh import REPORT_DAYS, store_dataset, write_report
from fleetlens.plans.reports import DATASETS, cohort_report
from fleetlens.sinks import new_run, publish, read_dataset, runs_of, settle
from fleetlens.sources.catalogue import catalogue_frame
from fleetlens.sources.tables import Fleet

WINDOWS = "windows"


@dataclass(frozen=True)
class Moving:
    """Facts that a report dataset needs by day: ``days`` makes the partials of facts in a range of time.

    ``ahead`` is by how many days the dataset's range ends after the report's.
    """

    table: str
    time: str
    days: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    counted: bool = True
    ahead: int = 0


def _counted(table: str, time: str, *keys: str, **names: str) -> Moving:
    def days(facts: DataFrame) -> DataFrame:
        return partials.day_counts(facts.withColumnsRenamed(names), ["wguid", *keys], time)

    return Moving(table, time, days, ("wguid", *keys))


def _changes(facts: DataFrame) -> DataFrame:
    return partials.day_newest(facts, ["wguid", "software"], "changetime", ["newversion"])


def _faults(facts: DataFrame) -> DataFrame:
    return partials.day_newest(presence.labelled_faults(facts), ["wguid", "appname"], "vwtime", ["app"])


def _scores(facts: DataFrame) -> DataFrame:
    return partials.day_sums(facts.where("activestatus = 1"), ["wguid"], "vwtime", "wscore")


MOVING = {
    "patches": _counted("patches", "installdate", "patchname"),
    "controllers": _counted("controllers", "datemodified", "controller", caption="controller"),
    "software": _counted("software", "installdate", "packagename", "version"),
    "app_usage": _counted("app_usage", "starttime", "applicationname"),
    "software_changes": Moving("software_changes", "changetime", _changes, ("wguid", "software"), counted=False),
    "app_faults": Moving("app_faults", "vwtime", _faults, ("wguid", "appname"), counted=False, ahead=1),
    "health": Moving("health_daily", "vwtime", _scores, ("wguid",), counted=False, ahead=1),
}


def _stored_days(fleet: Fleet, root: str, name: str, moving: Moving, start: date, end: date) -> DataFrame:
    """Writes the partials of the days from ``start`` to the midnight of ``end``; returns those of all days."""
    facts = in_range(fleet[moving.table], moving.time, start, end)
    fresh = moving.days(facts)
    path = f"{root}/partials/{name}"
    writer = fresh.hint("rebalance", partials.DAY).write.mode("overwrite").partitionBy(partials.DAY)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    fields = [f for f in fresh.schema.fields if f.name != partials.DAY]
    declared = StructType([*fields, fresh.schema[partials.DAY]])
    return fleet.spark.read.schema(declared).parquet(path)


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{WINDOWS}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _run_before(fleet: Fleet, sensors: Sequence[str], root: str, end: date) -> tuple[date, str] | None:
    """The day and folder of one earlier run that holds all the sensors and the windows, if it can be moved on."""
    wanted = set(sensors)
    for run, as_of, held in runs_of(fleet.spark, root):
        if wanted <= set(held) and as_of < end <= as_of + timedelta(days=REPORT_DAYS):
            try:
                fleet.spark.read.schema("n long").parquet(f"{root}/runs/{run}/{WINDOWS}/patches")
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                return None
            return as_of, f"{root}/runs/{run}"
    return None


def moving_refresh(fleet: Fleet, sensors: Sequence[str], root: str, as_of: Moment) -> str:
    """Writes and publishes what ``daily_refresh`` does for the midnight of ``as_of``; returns the run's name.

    Where the run before holds the windows of all these sensors, the facts are read from its day on only. Else, as the
    first time, the days of the whole window are read and kept.
    """
    end = day_start(as_of).date()
    start = end - timedelta(days=REPORT_DAYS)
    before = _run_before(fleet, sensors, root, end)
    run, folder = new_run(root, as_of)
    if before is None:
        results = cohort.sensor_results(fleet, start, end, sensors)
    else:
        since, old = before
        new = cohort.sensor_results(fleet, since, end, sensors)
        kind = new.schema["resulttime"].dataType
        kept = read_dataset(fleet.spark, old, "results", new.schema).where(F.col("sensor").isin(list(sensors)))
        kept = kept.where(F.col("resulttime") >= F.lit(str(start)).cast(kind))
        results = kept.unionByName(new.where(F.col("resulttime") > F.lit(str(since)).cast(kind)))
    results = store_dataset(results, folder, "results")
    windows, days = {}, {}
    for name, moving in MOVING.items():
        first = start if before is None else before[0]
        parts = _stored_days(fleet, root, name, moving, first, end + timedelta(days=moving.ahead))
        days[name] = parts
        if moving.counted and before is None:
            windows[name] = partials.merged(partials.inside(parts, start, end), moving.keys)
        elif moving.counted:
            since, old = before
            schema = partials.merged(parts, moving.keys).schema
            window = fleet.spark.read.schema(schema).parquet(f"{old}/{WINDOWS}/{name}")
            gained = partials.entering(parts, since, end)
            lost = partials.leaving(parts, since - timedelta(days=REPORT_DAYS), start)
            windows[name] = partials.moved(window, gained, lost, moving.keys)
        if moving.counted:
            windows[name] = _kept(windows[name], folder, name)
    catalogue = catalogue_frame(fleet.spark, sensors)
    write_report(fleet, catalogue, results, folder, start, end, as_of, lambda machines: window_report(windows, days, machines, start, end, as_of))
    publish(catalogue, root, run, as_of)
    return run


def window_report(
    windows: dict[str, DataFrame], days: dict[str, DataFrame], machines: DataFrame, start: date, end: date, as_of: Moment
) -> dict[str, DataFrame]:
    """The datasets that read facts, from counted windows and partials of days."""
    share = presence.presence_pct
    changes = partials.inside(days["software_changes"], start, end)
    changes = partials.merged_newest(changes, ["wguid", "software"], "changetime", ["newversion"])
    faults = partials.inside(days["app_faults"], start, end + timedelta(days=1))
    faults = partials.merged_newest(faults, ["wguid", "appname"], "vwtime", ["app"])
    scores = health.score_categories(window_scores(days["health"], end))
    return {
        "patches": share(windows["patches"], machines, ["patchname"], weight="n"),
        "controllers": share(windows["controllers"], machines, ["controller"], weight="n"),
        "software": share(windows["software"], machines, ["packagename", "version"], weight="n"),
        "app_usage": share(windows["app_usage"], machines, ["applicationname"], mode="machines", weight="n"),
        "software_changes": share(changes, machines, ["software", "newversion"]),
        "app_faults": presence.latest_fault_presence(faults, machines, end),
        "health": health.summary(scores, machines),
        "health_members": health.members(scores, machines),
    }


def stored_report(
    fleet: Fleet,
    root: str,
    sensors: Sequence[str] | None = None,
    *,
    model: str | None = None,
    year: int | None = None,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """The published report again for the machines with a model or a purchase year, without reading facts.

    The datasets of facts are shares of counted windows and partials that a moving run has stored, the others come
    from the tables of machines. With neither model nor year, the report is that of the whole cohort. ``folder`` as in
    ``reports.drilldown``. Only sensors whose run has stored its windows can be asked for.
    """
    spark = fleet.spark
    wanted = None if sensors is None else set(sensors)
    runs = [(run, as_of, held) for run, as_of, held in runs_of(spark, root) if wanted is None or wanted & set(held)]
    if len(runs) != 1:
        raise ValueError(f"the sensors are held by {len(runs)} runs; a report is drilled down within one")
    run, end, held = runs[0]
    held = held if wanted is None else sorted(set(held) & wanted)
    start, old = end - timedelta(days=REPORT_DAYS), f"{root}/runs/{run}"
    kind = fleet["sensor_results_daily"].schema["wguid"].dataType
    schema = StructType([StructField("sensor", StringType()), StructField("wguid", kind)])
    machines = read_dataset(spark, old, "cohort", schema).where(F.col("sensor").isin(held))
    if model is not None or year is not None:
        machines = profile.machines_with(fleet, machines, model=model, year=year)
    if folder is not None:
        machines = settle(machines, folder)
    windows, days = {}, {}
    for name, moving in MOVING.items():
        shape = moving.days(fleet[moving.table])  # for its schema; nothing of it is read
        declared = [f for f in shape.schema.fields if f.name != partials.DAY]
        parts = spark.read.schema(StructType([*declared, shape.schema[partials.DAY]])).parquet(f"{root}/partials/{name}")
        days[name] = parts
        if moving.counted:
            windows[name] = spark.read.schema(partials.merged(parts, moving.keys).schema).parquet(f"{old}/{WINDOWS}/{name}")
    found = window_report(windows, days, machines, start, end, end)
    return found | cohort_report(fleet, machines, start, end, end, [name for name in DATASETS if name not in found])


def window_scores(days: DataFrame, end: date) -> DataFrame:
    """``(wguid, score_7, score_30)``: mean scores from sums by day, as ``health.machine_health`` at the midnight of ``end``."""
    parts = partials.inside(days, end - timedelta(days=max(health.WINDOWS)), end + timedelta(days=1))
    means = []
    for width in health.WINDOWS:
        within = F.col(partials.DAY) >= F.lit(end - timedelta(days=width))
        sums = {c: F.sum(F.when(within, F.col(c))) for c in ("total", "n", "exact")}
        # Days kept by an earlier version have no exact sums: they count as scores without a decimal.
        sums["n_exact"] = F.sum(F.when(within, F.coalesce("n_exact", F.lit(0))))
        means.append(mean_score(sums).alias(f"score_{width}"))
    return parts.groupBy("wguid").agg(*means)
