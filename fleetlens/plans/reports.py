"""Reports: the datasets of a cohort, for all its sensors at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.times import Moment
from fleetlens.operators import health, presence, profile
from fleetlens.sinks import settle
from fleetlens.sources.tables import Fleet

# (fleet, cohort, start, end, as_of) -> dataset. Fault and health datasets hold both windows, in ``days``.
DATASETS: dict[str, Callable[[Fleet, DataFrame, Moment | None, Moment | None, Moment], DataFrame]] = {
    "patches": lambda f, c, start, end, _: presence.patch_presence(f, c, start, end),
    "controllers": lambda f, c, start, end, _: presence.controller_presence(f, c, start, end),
    "software": lambda f, c, start, end, _: presence.software_presence(f, c, start, end),
    "software_changes": lambda f, c, start, end, _: presence.software_change_presence(f, c, start, end),
    "bios": lambda f, c, *_: presence.bios_presence(f, c),
    "app_faults": lambda f, c, start, end, as_of: presence.app_fault_presence(f, c, as_of),
    "app_usage": lambda f, c, start, end, _: presence.app_usage_presence(f, c, start, end),
    "manufacture_years": lambda f, c, *_: profile.manufacture_year_counts(f, c),
    "models": lambda f, c, *_: profile.model_counts(f, c),
    "locations": lambda f, c, *_: profile.location_counts(f, c),
    "assets": lambda f, c, *_: profile.asset_info(f, c),
    "job_titles": lambda f, c, *_: profile.top_job_titles(f, c),
    "health": lambda f, c, start, end, as_of: health.health_summary(f, c, as_of),
    "health_members": lambda f, c, start, end, as_of: health.health_members(f, c, as_of),
}


def cohort_report(
    fleet: Fleet,
    cohort: DataFrame,
    start: Moment | None,
    end: Moment | None,
    as_of: Moment,
    datasets: Sequence[str] = tuple(DATASETS),
    *,
    few_machines: bool = False,
) -> dict[str, DataFrame]:
    """The wanted datasets by name. Lazy: each runs when it is used.

    Every dataset reads the cohort, so pass a stored one (``sinks.settle``, or as ``daily_refresh``
    does). With a cohort ``(sensor, wguid, date_from, date_to)`` every sensor has its own range, and
    ``start`` and ``end`` should enclose all ranges: they reach the scans, which the ranges, known only when
    the job runs, cannot. ``few_machines`` says that the cohort is a small part of the fleet: the facts are
    then restricted to it before they are reduced.
    """
    facts = fleet.restricted(cohort) if few_machines else fleet
    return {name: DATASETS[name](facts, cohort, start, end, as_of) for name in datasets}


def drilldown(
    fleet: Fleet,
    cohort: DataFrame,
    start: Moment | None,
    end: Moment | None,
    as_of: Moment,
    *,
    model: str | None = None,
    year: int | None = None,
    datasets: Sequence[str] = tuple(DATASETS),
    few_machines: bool = True,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """The report of only those machines that have the model or the purchase year, each sensor's own range kept.

    With a ``folder`` the sub-cohort is stored there once; without, each dataset works it out.
    """
    part = profile.machines_with(fleet, cohort, model=model, year=year)
    if folder is not None:
        part = settle(part, folder)
    return cohort_report(fleet, part, start, end, as_of, datasets, few_machines=few_machines)


def report_rows(datasets: dict[str, DataFrame]) -> DataFrame:
    """All datasets of a report as one frame ``(dataset, sensor, label, value)``.

    The label joins the columns that name a row, the value is its percentage or count; rows of datasets without
    a number count as often as they occur.
    """
    parts = []
    for name, df in datasets.items():
        number = next((c for c in ("system_percentage", "count", "machine_count") if c in df.columns), None)
        names = [c for c in df.columns if c not in ("sensor", number, "rank")]
        label = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(names)])
        rows = df.select(F.lit(name).alias("dataset"), "sensor", label.alias("label"), F.col(number) if number else F.lit(1).alias("n"))
        value = rows.columns[-1]
        parts.append(rows.groupBy("dataset", "sensor", "label").agg(F.sum(F.col(value).cast("double")).alias("value")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def uploaded_report(
    fleet: Fleet,
    machines: DataFrame,
    list_name: str,
    start: Moment | None,
    end: Moment | None,
    as_of: Moment,
    datasets: Sequence[str] = tuple(DATASETS),
) -> dict[str, DataFrame]:
    """The report of an uploaded list of machines (``cohort.machine_lookup``), under the name of the list."""
    cohort = machines.select(F.lit(list_name).alias("sensor"), "wguid").where("wguid is not null").distinct()
    return cohort_report(fleet, cohort, start, end, as_of, datasets, few_machines=True)
