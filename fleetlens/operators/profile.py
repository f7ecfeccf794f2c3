"""What kind of machines a cohort consists of: year, model, place, job title.

Counts are counts of joined rows, not of distinct machines: a machine with two asset rows counts
twice. Each side is therefore counted per join key first, and the counts are multiplied; no join
repeats rows, even where a key holds a large part of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import city_label, host_part
from fleetlens.sources.tables import Fleet


def _weighted(machines: DataFrame, cohort: DataFrame, label: str) -> DataFrame:
    """Sums the weights ``n`` of ``(wguid, label, n)`` per sensor and label; NULL labels drop out."""
    known = machines.filter(F.col(label).isNotNull())
    per_machine = known.groupBy("wguid", label).agg(F.sum("n").alias("n"))
    joined = per_machine.join(cohort.select("sensor", "wguid"), "wguid")
    return joined.groupBy("sensor", label).agg(F.sum("n").alias("count"))


def _hosts(fleet: Fleet, *columns: str) -> DataFrame:
    config = fleet["system_config"].select("wguid", host_part("systemid").alias("hostname"), *columns)
    return config.groupBy("wguid", "hostname", *columns).agg(F.count(F.lit(1)).alias("n_hosts"))


def _assets(fleet: Fleet, *columns: Column) -> DataFrame:
    """Asset rows per host and label columns, counted as often as their location is listed."""
    places = fleet["locations"].groupBy("loc_id").agg(F.count(F.lit(1)).alias("n_places"))
    assets = fleet["assets"].select("hostname", F.col("assetlocation").alias("loc_id"), *columns)
    labels = assets.columns[2:]
    counted = assets.groupBy("hostname", "loc_id", *labels).agg(F.count(F.lit(1)).alias("n_assets"))
    located = counted.join(places, "loc_id", "left")
    rows = F.col("n_assets") * F.coalesce("n_places", F.lit(1))
    return located.groupBy("hostname", *labels).agg(F.sum(rows).alias("n_assets"))


def _product(hosts: DataFrame, assets: DataFrame) -> DataFrame:
    return hosts.join(assets, "hostname").withColumn("n", F.col("n_hosts") * F.col("n_assets"))


def manufacture_year_counts(fleet: Fleet, cohort: DataFrame) -> DataFrame:
    """Asset rows per purchase year."""
    assets = _assets(fleet, F.year("invoicedt").alias("year"))
    return _weighted(_product(_hosts(fleet), assets), cohort, "year")


def model_counts(fleet: Fleet, cohort: DataFrame) -> DataFrame:
    """Asset rows per machine model."""
    return _weighted(_product(_hosts(fleet, "model"), _assets(fleet)), cohort, "model")


def location_counts(fleet: Fleet, cohort: DataFrame) -> DataFrame:
    """Asset rows per ``CITY,country``."""
    named = fleet["locations"].select("loc_id", city_label("loc_remark", "country").alias("location"))
    places = named.groupBy("loc_id", "location").agg(F.count(F.lit(1)).alias("n_places"))
    assets = fleet["assets"].groupBy("hostname", F.col("assetlocation").alias("loc_id"))
    located = assets.agg(F.count(F.lit(1)).alias("n_rows")).join(places, "loc_id")
    rows = F.sum(F.col("n_rows") * F.col("n_places")).alias("n_assets")
    per_host = located.groupBy("hostname", "location").agg(rows)
    return _weighted(_product(_hosts(fleet), per_host), cohort, "location")


def asset_info(fleet: Fleet, cohort: DataFrame) -> DataFrame:
    """The asset rows of the cohort's machines, with model and location, per sensor."""
    machines = cohort.select("sensor", "wguid")
    config = fleet["system_config"].select(
        "wguid", "manufacturer", "model", host_part("systemid").alias("hostname")
    )
    assets = fleet["assets"].select("hostname", "invoicedt", "assetlocation")
    places = fleet["locations"].select(F.col("loc_id").alias("assetlocation"), "loc_remark", "country")
    rows = config.join(assets, "hostname").join(places, "assetlocation", "left")
    return rows.join(machines, "wguid").select(
        "sensor",
        "wguid",
        "manufacturer",
        "model",
        "hostname",
        "invoicedt",
        "assetlocation",
        "loc_remark",
        "country",
    )


def job_title_counts(fleet: Fleet, cohort: DataFrame) -> DataFrame:
    """Rows per job title of users whose machine is in the directory."""
    listed = fleet["directory_computers"].groupBy(F.col("name").alias("systemid"))
    listed = listed.agg(F.count(F.lit(1)).alias("n_listed"))
    users = fleet["users"].groupBy("wguid", "systemid", "jobtitle")
    users = users.agg(F.count(F.lit(1)).alias("n_users"))
    joined = users.join(listed, "systemid").withColumn("n", F.col("n_users") * F.col("n_listed"))
    return _weighted(joined, cohort, "jobtitle")


def top_job_titles(fleet: Fleet, cohort: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent job titles per sensor, ties by name."""
    best = Window.partitionBy("sensor").orderBy(F.desc("count"), "jobtitle")
    ranked = job_title_counts(fleet, cohort).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k)


def share_with_other(counts: DataFrame, label: str, threshold: float = 0.05, other: str = "Other") -> DataFrame:
    """Counts per sensor and label, with all shares below the threshold added up as one "Other" row.

    The "Other" row is always there, with 0 if no share is small.
    """
    sums = counts.groupBy("sensor", label).agg(F.sum("count").alias("count"))
    totals = sums.groupBy("sensor").agg(F.sum("count").alias("total"))
    small = F.try_divide("count", "total") < threshold
    shared = sums.join(totals, "sensor").select("sensor", label, "count", small.alias("small"))
    kept = F.when(~F.col("small"), F.struct(F.col(label).alias("label"), F.col("count").alias("value")))
    folded = F.struct(
        F.lit(other).alias("label"), F.when(F.col("small"), F.col("count")).otherwise(0).alias("value")
    )
    # Every label adds its (possibly zero) part to "Other", so the row exists for every sensor.
    parts = shared.select("sensor", F.explode(F.array_compact(F.array(kept, folded))).alias("part"))
    return parts.groupBy("sensor", F.col("part.label").alias("label")).agg(F.sum("part.value").alias("value"))


def machines_with(fleet: Fleet, cohort: DataFrame, *, model: str | None = None, year: int | None = None) -> DataFrame:
    """The rows of the cohort, with all their columns, whose machine has the model or the purchase year.

    Machines are chosen from hosts and assets alone; a machine without an asset row has neither.
    """
    config, assets = fleet["system_config"], fleet["assets"]
    if model is not None:
        config = config.filter(F.col("model") == model)
    if year is not None:
        assets = assets.filter(F.year("invoicedt") == year)
    hosts = config.select("wguid", host_part("systemid").alias("hostname"))
    chosen = hosts.join(assets.select("hostname"), "hostname", "left_semi").select("wguid").distinct()
    return cohort.join(chosen, "wguid", "left_semi").select(*cohort.columns)


def sorted_counts(counts: DataFrame, label: str) -> DataFrame:
    """Counts per sensor, the largest first, ties by label."""
    leading = [c for c in ("sensor",) if c in counts.columns and c != label]
    return counts.orderBy(*leading, F.desc("count"), label)
