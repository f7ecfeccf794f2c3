"""Health categories of a cohort over the last 7 and 30 days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import HEALTH_CATEGORIES, day_start, health_category, in_range, mean_score, moment, score_sums
from fleetlens.functions.times import Moment
from fleetlens.sources.tables import Fleet

WINDOWS = (7, 30)


def machine_health(fleet: Fleet, as_of: Moment) -> DataFrame:
    """Mean score category of the machines: ``(wguid, category_7, category_30)``.

    Both windows come from one scan. The scan keeps whole days; the windows start at the time of ``as_of``.
    """
    facts = in_range(fleet["health_daily"], "vwtime", day_start(as_of, -30), day_start(as_of, 1))
    facts = facts.filter(F.col("activestatus") == 1)
    kind = facts.schema["vwtime"].dataType
    clock = moment(as_of) - day_start(as_of)
    means = []
    for days in WINDOWS:
        since = F.lit(str(day_start(as_of, -days) + clock)).cast(kind)
        means.append(mean_score(score_sums(F.when(F.col("vwtime") >= since, F.col("wscore")))).alias(f"score_{days}"))
    return score_categories(facts.groupBy("wguid").agg(*means))


def score_categories(scores: DataFrame) -> DataFrame:
    """``(wguid, category_7, category_30)`` of ``(wguid, score_7, score_30)``."""
    return scores.select("wguid", *[health_category(f"score_{d}").alias(f"category_{d}") for d in WINDOWS])


def health_summary(fleet: Fleet, cohort: DataFrame, as_of: Moment) -> DataFrame:
    """``summary`` of the machines' health at ``as_of``."""
    return summary(machine_health(fleet, as_of), cohort)


def summary(categories: DataFrame, cohort: DataFrame) -> DataFrame:
    """Machines per sensor, window and category; every category is listed, also with 0 machines.

    The machines themselves are in ``health_members``, as rows: a set of all machines in one cell
    would have to be built by one task.
    """
    scored = cohort.select("sensor", "wguid").join(categories, "wguid", "left")
    counts, cells = [], []
    for days in WINDOWS:
        for rank, (name, _) in enumerate(HEALTH_CATEGORIES, start=1):
            column = f"n_{days}_{rank}"
            counts.append(F.count_if(F.col(f"category_{days}") == name).alias(column))
            cells.append(
                F.struct(
                    F.lit(days).alias("days"),
                    F.lit(rank).alias("rank"),
                    F.lit(name).alias("health_score"),
                    F.col(column).alias("machine_count"),
                )
            )
    return scored.groupBy("sensor").agg(*counts).select("sensor", F.inline(F.array(*cells)))


def health_members(fleet: Fleet, cohort: DataFrame, as_of: Moment) -> DataFrame:
    """The machines behind ``health_summary``: ``(sensor, days, health_score, wguid)``."""
    return members(machine_health(fleet, as_of), cohort)


def members(categories: DataFrame, cohort: DataFrame) -> DataFrame:
    """The machines behind ``summary``."""
    scored = cohort.select("sensor", "wguid").join(categories, "wguid")
    windows = F.array(
        *[
            F.struct(F.lit(days).alias("days"), F.col(f"category_{days}").alias("health_score"))
            for days in WINDOWS
        ]
    )
    members = scored.select("sensor", "wguid", F.inline(windows))
    return members.filter(F.col("health_score").isNotNull()).select("sensor", "days", "health_score", "wguid")


def health_window_compare(summary: DataFrame) -> DataFrame:
    """Both windows stacked for display: type, label, value."""
    # The labels of the display.
    kind = F.when(F.col("days") == 7, F.lit("Last 7 Days")).otherwise(F.lit("Last 30 days"))
    return summary.select(
        "sensor",
        kind.alias("type"),
        F.col("health_score").alias("label"),
        F.col("machine_count").alias("value"),
    )
