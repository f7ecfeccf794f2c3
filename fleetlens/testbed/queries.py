"""One registered query per operator, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fleetlens.functions import in_range
from fleetlens.operators import anomaly, cohort, compare, cosensor, enriched, health, partials, presence, profile, timeseries
from fleetlens.plans import moving, reports
from fleetlens.sources.tables import Fleet
from fleetlens.testbed import settings as s
from fleetlens.testbed.fleet import (
    DOMAIN,
    USER_PREFIX,
    order_fleet,
    standin_fleet,
    uploaded_hosts,
    uploaded_users,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at 4 decimals, as in the checking SQL."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    return df.select(*[F.round(c, 4).alias(c) if c in doubles else F.col(c) for c in df.columns])


def query(build: Callable[[Fleet], DataFrame]) -> Callable[[Fleet], DataFrame]:
    """Registers a query that is built from the fleet tables alone."""
    REGISTRY[build.__name__] = lambda spark, sf_dir: rounded(build(standin_fleet(spark, sf_dir)))
    return build


def query_with_upload(build: Callable[[Fleet, SparkSession, str], DataFrame]) -> Query:
    """Registers a query that also reads an uploaded list."""
    REGISTRY[build.__name__] = lambda spark, sf_dir: rounded(build(standin_fleet(spark, sf_dir), spark, sf_dir))
    return build


def machines(fleet: Fleet) -> DataFrame:
    return cohort.cohort(cohort.daily_results(fleet, s.COHORT_FROM, s.COHORT_TO))


def event_series(fleet: Fleet) -> DataFrame:
    return timeseries.daily_series(cohort.daily_results(fleet))


def event_points(fleet: Fleet) -> DataFrame:
    return anomaly.sigma_anomalies(event_series(fleet), sigmas=s.EVENT_SIGMAS)


def order_points(orders: Fleet) -> DataFrame:
    series = timeseries.daily_series(cohort.daily_results(orders))
    return anomaly.sigma_anomalies(series, sigmas=s.ORDER_SIGMAS)


def order_cohort(orders: Fleet) -> DataFrame:
    days = anomaly.anomaly_days(order_points(orders))
    hit = cohort.on_days(cohort.daily_results(orders), days)
    return anomaly.ranged_cohort(cohort.cohort(hit), days)


def order_report(fleet: Fleet, build: Callable[..., DataFrame]) -> DataFrame:
    """Few machines have a result on an abnormal day, so the facts are restricted to them."""
    orders = order_fleet(fleet)
    found = order_cohort(orders)
    return build(orders.restricted(found), found, s.ORDERS_FROM, s.ORDERS_TO, threshold=s.LOW)


# Timeline and cohort


@query
def sensor_timeline(fleet):
    return cohort.timeline(cohort.daily_results(fleet))


@query
def timeline_labels(fleet):
    return cohort.with_day_label(cohort.timeline(cohort.daily_results(fleet)))


@query
def sensor_cohort(fleet):
    return cohort.sensor_results(fleet, s.COHORT_FROM, s.COHORT_TO, ["error", "click", "purchase"])


@query
def severe_results(fleet):
    return cohort.raw_results(fleet, s.COHORT_FROM, s.COHORT_TO, ["error", "click", "view"])


@query
def cohort_machines(fleet):
    return cohort.cohort_size(machines(fleet))


@query
def cosensor_pairs(fleet):
    return cosensor.cosensor_results(cohort.raw_results(fleet), s.PAIRS, keys=["wguid", "resultdate"])


@query
def cosensor_timeline(fleet):
    pairs = cosensor.cosensor_results(cohort.raw_results(fleet), s.PAIRS, keys=["wguid", "resultdate"])
    return cohort.timeline(pairs)


@query
def cosensor_as_written(fleet):
    return cosensor.cosensor_results(cohort.raw_results(fleet), s.WRITTEN_PAIRS, keys=["wguid", "resultdate"])


@query
def cosensor_frequent(fleet):
    """All pairs of events and order priorities that many machines have both."""
    seen = fleet["derived_sensors"].select("wguid", F.col("sensorname").alias("sensor"))
    both = cohort.raw_results(fleet).select("wguid", "sensor").unionByName(seen)
    return cosensor.frequent_pairs(both, s.SHARED, keys=["wguid"])


@query
def cosensor_frequent_results(fleet):
    raw = cohort.raw_results(fleet)
    return cosensor.frequent_cosensor_results(raw, s.SHARED, keys=["wguid", "resultdate"])


@query
def anomaly_day_cohort(fleet):
    days = anomaly.anomaly_days(event_points(fleet))
    return cohort.cohort(cohort.on_days(cohort.daily_results(fleet), days))


@query
def anomaly_day_timeline(fleet):
    days = anomaly.anomaly_days(event_points(fleet))
    return cohort.timeline(cohort.on_days(cohort.daily_results(fleet), days))


@query_with_upload
def machine_sensor_timeline(fleet, spark, sf_dir):
    return cohort.timeline(_uploaded_results(fleet, spark, sf_dir))


@query_with_upload
def machine_sensor_breakdown(fleet, spark, sf_dir):
    return cohort.sensor_breakdown(_uploaded_results(fleet, spark, sf_dir))


@query_with_upload
def sensor_breakdown_sorted(fleet, spark, sf_dir):
    return profile.sorted_counts(cohort.sensor_breakdown(_uploaded_results(fleet, spark, sf_dir)), "sensor")


@query_with_upload
def uploaded_report(fleet, spark, sf_dir):
    found = cohort.machine_lookup(fleet, uploaded_hosts(spark, sf_dir), by="host", domain=DOMAIN)
    bounds = (s.ITEMS_FROM, s.ITEMS_TO, s.AS_OF)
    return reports.report_rows(reports.uploaded_report(fleet, found, "uploaded", *bounds))


def _uploaded_results(fleet, spark, sf_dir):
    found = cohort.machine_lookup(fleet, uploaded_hosts(spark, sf_dir), by="host", domain=DOMAIN)
    return cohort.machine_results(fleet, found, s.MONTH_FROM, s.MONTH_TO, ["click", "error"])


@query_with_upload
def machine_lookup(fleet, spark, sf_dir):
    return cohort.machine_lookup(fleet, uploaded_hosts(spark, sf_dir), by="host", domain=DOMAIN)


@query_with_upload
def machine_lookup_user(fleet, spark, sf_dir):
    return cohort.machine_lookup(fleet, uploaded_users(spark, sf_dir), by="user", prefix=USER_PREFIX)


@query
def silent_sensors(fleet):
    seen = fleet["derived_sensors"].select(F.col("sensorname").alias("sensor"))
    listed = fleet["sensor_results_daily"].select(F.col("sensorname").alias("sensor"))
    return cohort.silent_sensors(listed.unionByName(seen).distinct(), machines(fleet))


@query
def sensor_descriptions(fleet):
    info = fleet["sensor_information"]
    rows = fleet["sensor_results_raw"].join(info, F.col("sensorid") == F.col("ruleid"), "left")
    named = rows.select(F.coalesce("description", "sensorname").alias("sensor")).distinct()
    return cohort.with_description(named, fleet["sensor_definitions"])


@query
def export_system_ids(fleet):
    return cohort.system_ids(cohort.daily_results(fleet), s.COHORT_FROM, s.COHORT_TO)


@query
def export_last_week(fleet):
    return cohort.last_week(cohort.daily_results(fleet), s.AS_OF)


# Presence


@query
def patch_presence(fleet):
    return presence.patch_presence(fleet, machines(fleet), s.ITEMS_FROM, s.ITEMS_TO)


@query
def controller_presence(fleet):
    return presence.controller_presence(fleet, machines(fleet), s.ITEMS_FROM, s.ITEMS_TO)


@query
def software_presence(fleet):
    return presence.software_presence(fleet, machines(fleet), s.ITEMS_FROM, s.ITEMS_TO, threshold=s.LOW)


@query
def software_change_presence(fleet):
    return presence.software_change_presence(fleet, machines(fleet), s.ITEMS_FROM, s.ITEMS_TO, threshold=1.0)


@query
def bios_presence(fleet):
    return presence.bios_presence(fleet, machines(fleet))


@query
def app_fault_presence(fleet):
    return presence.same_length_faults(presence.app_fault_presence(fleet, machines(fleet), s.AS_OF))


@query
def app_fault_presence_whole(fleet):
    return presence.app_fault_presence(fleet, machines(fleet), s.AS_OF)


@query
def app_usage_presence(fleet):
    return presence.app_usage_presence(fleet, machines(fleet), s.ITEMS_FROM, s.ITEMS_TO, threshold=20.0)


@query
def presence_machines(fleet):
    return presence.patch_presence(
        fleet, machines(fleet), s.ITEMS_FROM, s.ITEMS_TO, threshold=20.0, mode="machines"
    )


@query
def presence_all_sensors(fleet):
    everywhere = cohort.cohort(cohort.daily_results(fleet))
    return presence.patch_presence(fleet, everywhere, threshold=0.0)


@query
def presence_threshold_edge(fleet):
    return presence.bios_presence(fleet, machines(fleet), threshold=7.0)


@query
def presence_sorted(fleet):
    return presence.sorted_presence(presence.software_presence(fleet, machines(fleet), threshold=s.LOW))


@query
def presence_top15(fleet):
    found = presence.software_presence(fleet, machines(fleet), threshold=s.LOW)
    return presence.top_presence(found, ["packagename", "version"], 15, short_from="packagename")


@query
def presence_top3(fleet):
    found = presence.bios_presence(fleet, machines(fleet))
    return presence.top_presence(found, ["name", "date"], 3, separator="_")


@query
def fault_window_compare(fleet):
    return presence.fault_window_compare(
        presence.same_length_faults(presence.app_fault_presence(fleet, machines(fleet), s.AS_OF))
    )


@query
def drilldown_model(fleet):
    return _drilldown(fleet, "patches", model="MACHINERY")


@query
def drilldown_year(fleet):
    return _drilldown(fleet, "controllers", year=1998)


@query
def drilldown_ranged(fleet):
    orders = order_fleet(fleet)
    part = profile.machines_with(orders, order_cohort(orders), model="MACHINERY")
    return presence.patch_presence(orders.restricted(part), part, s.ORDERS_FROM, s.ORDERS_TO, threshold=s.LOW)


@query
def whole_report(fleet):
    found = reports.cohort_report(fleet, machines(fleet), s.ITEMS_FROM, s.ITEMS_TO, s.AS_OF, few_machines=True)
    return reports.report_rows(found)


def _drilldown(fleet, dataset, **chosen):
    wanted = {"datasets": [dataset], **chosen}
    return reports.drilldown(fleet, machines(fleet), s.ITEMS_FROM, s.ITEMS_TO, s.AS_OF, **wanted)[dataset]


# Profile and health


@query
def asset_info(fleet):
    return profile.asset_info(fleet, machines(fleet))


@query
def year_counts(fleet):
    return profile.manufacture_year_counts(fleet, machines(fleet))


@query
def model_counts(fleet):
    return profile.model_counts(fleet, machines(fleet))


@query
def location_counts(fleet):
    return profile.location_counts(fleet, machines(fleet))


@query
def title_top20(fleet):
    return profile.top_job_titles(fleet, machines(fleet))


@query
def share_with_other(fleet):
    return profile.share_with_other(profile.location_counts(fleet, machines(fleet)), "location")


@query
def health_summary(fleet):
    return health.health_summary(fleet, machines(fleet), s.AS_OF)


@query
def health_members(fleet):
    return health.health_members(fleet, machines(fleet), s.AS_OF)


@query
def health_two_windows(fleet):
    return health.health_window_compare(health.health_summary(fleet, machines(fleet), s.AS_OF))


# Windows moved by days


def _moved_window(fleet, name):
    """The counts of a window, moved: each scan reads only the days that enter, leave or were there before."""
    how = moving.MOVING[name]

    def days(start, end):
        return how.days(in_range(fleet[how.table], how.time, start, end))

    before = partials.merged(partials.inside(days(s.WINDOW_FROM, s.WINDOW_TO), s.WINDOW_FROM, s.WINDOW_TO), how.keys)
    gained = partials.entering(days(s.WINDOW_TO, s.MOVED_TO), s.WINDOW_TO, s.MOVED_TO)
    lost = partials.leaving(days(s.WINDOW_FROM, s.MOVED_FROM), s.WINDOW_FROM, s.MOVED_FROM)
    return partials.moved(before, gained, lost, how.keys)


@query
def moved_patches(fleet):
    window = _moved_window(fleet, "patches")
    return presence.presence_pct(window, machines(fleet), ["patchname"], threshold=s.LOW, weight="n")


@query
def moved_software(fleet):
    window = _moved_window(fleet, "software")
    return presence.presence_pct(window, machines(fleet), ["packagename", "version"], threshold=1.0, weight="n")


@query
def moved_usage(fleet):
    window = _moved_window(fleet, "app_usage")
    return presence.presence_pct(window, machines(fleet), ["applicationname"], threshold=s.LOW, mode="machines", weight="n")


@query
def merged_changes(fleet):
    how = moving.MOVING["software_changes"]
    days = how.days(in_range(fleet[how.table], how.time, s.MOVED_FROM, s.MOVED_TO))
    newest = partials.merged_newest(partials.inside(days, s.MOVED_FROM, s.MOVED_TO), how.keys, how.time, ["newversion"])
    return presence.presence_pct(newest, machines(fleet), ["software", "newversion"], threshold=1.0)


@query
def merged_health(fleet):
    how = moving.MOVING["health"]
    end = date.fromisoformat(s.MONTH_TO) - timedelta(days=1)
    facts = in_range(fleet[how.table], how.time, end - timedelta(days=30), end + timedelta(days=1))
    return health.summary(health.score_categories(moving.window_scores(how.days(facts), end)), machines(fleet))


# Two machines


@query
def compare_machines(fleet):
    return compare.compare_machines(compare.machine_items(fleet, s.COMPARE_FROM, s.COMPARE_TO), *s.COMPARED)


@query
def item_matrix(fleet):
    items = compare.machine_items(fleet, s.COMPARE_FROM, s.COMPARE_TO).filter(F.col("kind") == "sensor")
    return compare.item_matrix(items, s.EVENT_TYPES)


# Series and anomalies


@query
def sensor_enriched(fleet):
    return enriched.sensor_enriched(fleet, *s.ENRICHED_RANGE, sensors=s.ENRICHED_SENSORS)


@query
def enriched_series(fleet):
    return enriched.enriched_daily_series(fleet, *s.ENRICHED_RANGE, sensors=s.ENRICHED_SENSORS)


@query
def daily_series(fleet):
    return event_series(fleet)


@query
def series_all_days(fleet):
    results = cohort.daily_results(order_fleet(fleet))
    return timeseries.daily_series(results, fill_gaps=True)


@query
def series_slice(fleet):
    return timeseries.series_slice(event_series(fleet), s.COHORT_FROM, s.COHORT_TO)


@query
def trend(fleet):
    return timeseries.trend(event_series(fleet))


@query
def decompose(fleet):
    return timeseries.decompose(event_series(fleet))


@query
def rolling_stats(fleet):
    return timeseries.rolling_stats(event_series(fleet))


@query
def sigma_band(fleet):
    return timeseries.sigma_band(event_series(fleet))


@query
def sigma_anomalies(fleet):
    return event_points(fleet)


@query
def trend_anomalies(fleet):
    return anomaly.trend_anomalies(event_series(fleet))


@query
def trend_anomalies_yearly(fleet):
    orders = cohort.daily_results(order_fleet(fleet))
    return anomaly.trend_anomalies(timeseries.daily_series(orders))


@query
def anomaly_bounds(fleet):
    return anomaly.anomaly_bounds(anomaly.anomaly_days(event_points(fleet)))


@query
def anomaly_days_wide(fleet):
    return anomaly.anomaly_days_wide(anomaly.anomaly_days(event_points(fleet)), s.EVENT_TYPES)


@query
def snapshot_change(fleet):
    return anomaly.anomaly_snapshot(event_points(fleet), s.SNAPSHOT_AS_OF)


@query
def anomaly_report_patches(fleet):
    return order_report(fleet, presence.patch_presence)


@query
def anomaly_report_patch_machines(fleet):
    return order_report(fleet, partial(presence.patch_presence, mode="machines"))


@query
def anomaly_report_changes(fleet):
    return order_report(fleet, presence.software_change_presence)


@query
def anomaly_report_usage(fleet):
    return order_report(fleet, presence.app_usage_presence)
