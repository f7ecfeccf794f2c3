from fleetlens.plans.moving import moving_refresh, stored_report
from fleetlens.plans.refresh import anomaly_refresh, backfill, daily_refresh
from fleetlens.plans.reports import cohort_report, drilldown, report_rows, uploaded_report

__all__ = [
    "anomaly_refresh",
    "backfill",
    "cohort_report",
    "daily_refresh",
    "drilldown",
    "moving_refresh",
    "report_rows",
    "stored_report",
    "uploaded_report",
]
