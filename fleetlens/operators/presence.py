"""How common an item is on the machines of a cohort, for all sensors in one job.

The cohort is a frame ``(sensor, wguid)``; with ``(sensor, wguid, date_from, date_to)`` every
sensor has its own date range. Results are ``(sensor, keys..., system_percentage)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fleetlens.functions import (
    count_upto,
    day_start,
    in_range,
    joined_label,
    latest_per,
    moment,
    percentage,
    short_label,
)
from fleetlens.functions.times import Moment
from fleetlens.sources.tables import Fleet

COMMON = 50.0
RARE = 5.0
_PLACE = "_place"


def has_own_range(cohort: DataFrame) -> bool:
    return "date_from" in cohort.columns


def _machine_counts(
    facts: DataFrame, by: Sequence[str], keys: Sequence[str], mode: str, weight: str | None = None
) -> DataFrame:
    """Per machine: one row per key with its row count, ``n``.

    ``by`` are further columns to keep apart; a row stands for ``weight`` rows where such a column is named.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    n = rows if mode == "rows" else F.lit(1).cast("long")
    return facts.groupBy(*by, "wguid", *keys).agg(n.alias("n"))


def _with_totals(counts: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Sums per key, and one row per machine that has any (``is_total``); nothing with a sum of 0.

    Both come out of the same pass, so numerator and denominator need one scan and one shuffle. Rows are doubled here,
    after the join with the cohort, where a machine's rows meet in few tasks: its own row is combined before the shuffle.
    """
    total = F.col("is_total")
    doubled = counts.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_total"))
    machine = F.when(total, F.col("wguid")).alias("wguid")
    blanked = [F.when(~total, F.col(k)).alias(k) for k in keys]
    doubled = doubled.select(*group, machine, *blanked, "is_total", "n")
    return doubled.groupBy(*group, "wguid", *keys, "is_total").agg(F.sum("n").alias("n")).where("n > 0")


def _place(time: str) -> Column:
    """The day of a time and whether it is later than its midnight, as one number; it decides any range of dates."""
    day = F.to_date(time)
    return (2 * F.unix_date(day) + (F.col(time) > day).cast("int")).alias(_PLACE)


def _own_range() -> tuple[Column, Column]:
    """The places of the range's last midnight and of what comes right before its first day."""
    return 2 * F.unix_date(F.col("date_to").cast("date")), 2 * F.unix_date(F.col("date_from").cast("date")) - 1


def _in_own_ranges(daily: DataFrame, cohort: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Counts of each key inside the range of each sensor of the machine, from counts by day.

    A machine and key become one row with its days in order and the counts up to each of them. The join with the
    cohort repeats that row once per sensor of the machine, and looks up the two ends of the sensor's range. Rows with
    nothing in a range stay, with 0: a filter here would be pushed into the join and look everything up twice.
    """
    group = [*by, "wguid", *keys]
    until_here = Window.partitionBy(*group).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = daily.where(F.col(_PLACE).isNotNull()).withColumn("n", F.sum("n").over(until_here))
    days = running.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(_PLACE, "n"))).alias("days"))
    days = days.select(*group, F.col(f"days.{_PLACE}").alias("places"), F.col("days.n").alias("running"))
    up_to = [F.coalesce(F.get("running", count_upto(F.col("places"), end) - 1), F.lit(0)) for end in _own_range()]
    ranged = days.join(cohort.where("date_from IS NOT NULL"), "wguid")
    return ranged.select("sensor", *group, (up_to[0] - up_to[1]).alias("n"))


def presence_pct(
    facts: DataFrame,
    cohort: DataFrame,
    keys: Sequence[str],
    *,
    threshold: float = COMMON,
    mode: str = "rows",
    within: Sequence[str] = (),
    time: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Share of the cohort's machines that have each key, in percent; strictly above the threshold.

    The denominator is the number of cohort machines that have any fact row. ``mode="rows"``
    counts rows, so repeated rows of one machine can pass 100; ``mode="machines"`` counts machines.
    NULL text keys form the group of one blank. ``within`` splits both counts, e.g. by window.
    If the cohort has per-sensor ranges, ``time`` names the fact time they apply to; without it
    the facts are taken whole. With ``weight``, facts were counted before (``partials``): that column says how many
    rows a row stands for.

    The facts are reduced to one row per machine and key before the join with the cohort, which
    repeats them once per sensor of the machine. The totals are read from the same shuffled result.
    """
    if mode not in ("rows", "machines"):
        raise ValueError(f"mode must be 'rows' or 'machines', not {mode!r}")
    text = [k for k in keys if isinstance(facts.schema[k].dataType, StringType)]
    facts = facts.na.fill(" ", subset=text) if text else facts
    if weight and ("sensor" in facts.columns or has_own_range(cohort)):
        raise ValueError("counted facts belong to one window: no sensors and no ranges of their own")
    if "sensor" in facts.columns:  # already joined with the cohort
        counts = _machine_counts(facts, ["sensor", *within], keys, mode)
    elif has_own_range(cohort) and time is not None:
        daily = _machine_counts(facts.select("*", _place(time)), [*within, _PLACE], keys, mode)
        counts = _in_own_ranges(daily, cohort, within, keys)
        if mode == "machines":
            counts = counts.withColumn("n", F.least("n", F.lit(1)))
    else:
        # The next shuffle is by key, so AQE is free to split a machine's partition of this join.
        counts = _machine_counts(facts, within, keys, mode, weight)
        counts = counts.join(cohort.select("sensor", "wguid"), "wguid")
    group = ["sensor", *within]
    sums = _with_totals(counts, group, keys)
    totals = sums.groupBy(*group).agg(F.count_if("is_total").alias("machines"))
    # One predicate over both sides: a filter on is_total alone would be pushed below the shuffle
    # of one side, and the two uses of ``sums`` could no longer share it.
    share = F.when(~F.col("is_total"), percentage(F.col("n"), F.col("machines")))
    rated = sums.join(totals, group).select(*group, *keys, share.alias("system_percentage"))
    return rated.filter(F.col("system_percentage") > threshold)


def _latest_in_range(facts: DataFrame, cohort: DataFrame, key: str, time: str, carry: Sequence[str]) -> DataFrame:
    """Newest row per machine and key. With per-sensor ranges: per sensor, among the rows in its range.

    For ranges, a machine and key become one row with the newest of each of its days in order; the last one at the end
    of a sensor's range is the newest inside, if it is not from before the range.
    """
    if not has_own_range(cohort):
        return latest_per(facts, ["wguid", key], time, carry)
    daily = latest_per(facts.select("*", _place(time)).where(F.col(_PLACE).isNotNull()), ["wguid", key, _PLACE], time, carry)
    days = daily.groupBy("wguid", key).agg(F.sort_array(F.collect_list(F.struct(_PLACE, time, *carry))).alias("days"))
    days = days.withColumn("places", F.col(f"days.{_PLACE}"))
    last, before = _own_range()
    found = F.get("days", count_upto(F.col("places"), last) - 1).alias("found")
    ranged = days.join(cohort, "wguid").select("sensor", "wguid", key, found, before.alias("before"))
    ranged = ranged.where(F.col(f"found.{_PLACE}") > F.col("before"))
    return ranged.select("sensor", "wguid", key, *[f"found.{c}" for c in (time, *carry)])


def patch_presence(
    fleet: Fleet,
    cohort: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    *,
    threshold: float = COMMON,
    mode: str = "rows",
) -> DataFrame:
    """Patches installed in the range."""
    facts = in_range(fleet["patches"], "installdate", start, end)
    return presence_pct(facts, cohort, ["patchname"], threshold=threshold, mode=mode, time="installdate")


def controller_presence(
    fleet: Fleet,
    cohort: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    *,
    threshold: float = COMMON,
    mode: str = "rows",
) -> DataFrame:
    """Controllers modified in the range."""
    facts = in_range(fleet["controllers"], "datemodified", start, end)
    facts = facts.withColumnRenamed("caption", "controller")
    return presence_pct(facts, cohort, ["controller"], threshold=threshold, mode=mode, time="datemodified")


def software_presence(
    fleet: Fleet,
    cohort: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    *,
    threshold: float = COMMON,
    mode: str = "rows",
) -> DataFrame:
    """Packages and versions installed in the range."""
    facts = in_range(fleet["software"], "installdate", start, end)
    keys = ["packagename", "version"]
    return presence_pct(facts, cohort, keys, threshold=threshold, mode=mode, time="installdate")


def software_change_presence(
    fleet: Fleet,
    cohort: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    *,
    threshold: float = COMMON,
) -> DataFrame:
    """Newest change of every software per machine in the range."""
    facts = in_range(fleet["software_changes"], "changetime", start, end)
    latest = _latest_in_range(facts, cohort, "software", "changetime", ["newversion"])
    return presence_pct(latest, cohort, ["software", "newversion"], threshold=threshold)


def bios_presence(fleet: Fleet, cohort: DataFrame, *, threshold: float = RARE, mode: str = "rows") -> DataFrame:
    """BIOS name and date; has no time range."""
    return presence_pct(fleet["bios"], cohort, ["name", "date"], threshold=threshold, mode=mode)


def app_fault_presence(
    fleet: Fleet,
    cohort: DataFrame,
    as_of: Moment,
    *,
    threshold: float = RARE,
) -> DataFrame:
    """Newest fault of every application per machine, over the last 7 and 30 days: column ``days``.

    The newest fault is chosen first and then tested against the 7 days.
    """
    facts = in_range(fleet["app_faults"], "vwtime", day_start(as_of, -30), day_start(as_of, 1))
    latest = latest_per(labelled_faults(facts), ["wguid", "appname"], "vwtime", ["app"])
    return latest_fault_presence(latest, cohort, as_of, threshold=threshold)


def labelled_faults(facts: DataFrame) -> DataFrame:
    """``wguid, appname, vwtime, app``; the label is NULL where the name or the version is."""
    label = F.concat(F.col("appname"), F.lit(" "), F.col("appver")).alias("app")
    return facts.select("wguid", "appname", "vwtime", label)


def latest_fault_presence(latest: DataFrame, cohort: DataFrame, as_of: Moment, *, threshold: float = RARE) -> DataFrame:
    """``app_fault_presence`` from the newest fault per machine and application."""
    week = F.lit(str(day_start(as_of, -7) + (moment(as_of) - day_start(as_of))))
    recent = F.col("vwtime") >= week.cast(latest.schema["vwtime"].dataType)
    windows = F.array_compact(F.array(F.lit(30), F.when(recent, F.lit(7))))
    stacked = latest.select("wguid", "app", F.explode(windows).alias("days"))
    return presence_pct(stacked, cohort, ["app"], threshold=threshold, within=["days"])


def same_length_faults(faults: DataFrame) -> DataFrame:
    """For display: the 30-day list with as many entries as the sensor's 7-day list, the highest percentages first."""
    # A listed entry takes more than the threshold's percent of the machines, so a sensor has few.
    best = Window.partitionBy("sensor", "days").orderBy(F.desc("system_percentage"), "app")
    weekly = F.count_if(F.col("days") == 7).over(Window.partitionBy("sensor"))
    ranked = faults.withColumn("position", F.row_number().over(best)).withColumn("weekly", weekly)
    return ranked.filter(F.col("position") <= F.col("weekly")).drop("position", "weekly")


def app_usage_presence(
    fleet: Fleet,
    cohort: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    *,
    threshold: float = COMMON,
) -> DataFrame:
    """Applications started in the range, once per machine: the newest row by end time.

    The newest row carries nothing but its key, so counting machines gives the same numbers.
    """
    facts = in_range(fleet["app_usage"], "starttime", start, end)
    keys = ["applicationname"]
    return presence_pct(facts, cohort, keys, threshold=threshold, mode="machines", time="starttime")


def sorted_presence(presence: DataFrame) -> DataFrame:
    """Highest percentages first, ties by name."""
    names = [c for c in presence.columns if c not in ("sensor", "system_percentage")]
    return presence.orderBy("sensor", F.desc("system_percentage"), *names)


def top_presence(
    presence: DataFrame,
    keys: Sequence[str],
    k: int = 15,
    *,
    separator: str = " ",
    short_from: str | None = None,
    short_length: int = 15,
) -> DataFrame:
    """The k most common entries per sensor, with a joined label and a short label for display."""
    label = joined_label(*keys, separator=separator)
    short = F.coalesce(F.col(short_from), F.lit("")) if short_from else label
    best = Window.partitionBy("sensor").orderBy(F.desc("system_percentage"), *keys)
    ranked = presence.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(
        "sensor",
        "rank",
        label.alias("label"),
        short_label(short, short_length).alias("short_label"),
        "system_percentage",
    )


def fault_window_compare(faults: DataFrame, short_length: int = 8) -> DataFrame:
    """Both fault windows stacked for display: type, label, short label, value."""
    kind = F.when(F.col("days") == 7, F.lit("Last 7 Days")).otherwise(F.lit("Last 30 days"))
    return faults.select(
        "sensor",
        kind.alias("type"),
        F.col("app").alias("label"),
        short_label("app", short_length).alias("short_label"),
        F.col("system_percentage").alias("value"),
    )
