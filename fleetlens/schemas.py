"""Declared schemas of the source tables. Readers use these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Column names and types of the fleet tables.
_DDL = {
    "sensor_results_daily": "wguid string, sensorname string, sensorsystemid string, resulttime timestamp",
    "sensor_results_raw": (
        "wguid string, systemid string, sensorid string, sensorname string, severity int, "
        "resulttime timestamp, instancevalue string"
    ),
    "derived_sensors": (
        "wguid string, sensorsystemid string, sensorid string, sensorname string, severity int, "
        "resulttime timestamp, instancevalue string"
    ),
    "system_config": (
        "wguid string, systemid string, totalphysicalmemory bigint, manufacturer string, model string"
    ),
    "sensor_information": "ruleid string, sensorcategory string, description string",
    "user_info": "wguid string, systemid string, username string",
    "patches": "wguid string, systemid string, patch_id string, patchname string, installdate timestamp",
    "controllers": (
        "wguid string, systemid string, caption string, manufacturer string, devicestatus string, "
        "datemodified timestamp"
    ),
    "software": (
        "wguid string, systemid string, packagename string, package_id string, version string, "
        "installdate timestamp"
    ),
    "software_changes": "wguid string, software string, newversion string, changetime timestamp",
    "bios": "wguid string, systemid string, name string, date date",
    "app_faults": "wguid string, vwtime timestamp, appname string, appver string",
    "app_usage": "wguid string, applicationname string, starttime timestamp, endtime timestamp",
    "users": "wguid string, systemid string, jobtitle string",
    "directory_computers": "name string, createddate timestamp",
    "assets": "hostname string, invoicedt timestamp, assetlocation string",
    "locations": "loc_id string, loc_remark string, country string",
    "health_daily": "wguid string, vwtime timestamp, wscore double, activestatus int",
    "devices": "wguid string, caption string, classguid string, adddate timestamp",
    "changes_daily": "wguid string, changedesc string, changeclass string, changetime timestamp",
    "sensor_definitions": "sensorname string, description string",
}

TABLES = tuple(_DDL)


def schema(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])


# Columns of the stored report datasets.
_SHARE = "system_percentage double"
REPORT_SCHEMAS = {
    "results": "sensor string, wguid string, sensorsystemid string, resulttime timestamp, resultdate date",
    "timeline": "sensor string, date date, count bigint",
    "cohort": "sensor string, wguid string",
    "patches": f"sensor string, patchname string, {_SHARE}",
    "controllers": f"sensor string, controller string, {_SHARE}",
    "software": f"sensor string, packagename string, version string, {_SHARE}",
    "software_changes": f"sensor string, software string, newversion string, {_SHARE}",
    "bios": f"sensor string, name string, date date, {_SHARE}",
    "app_faults": f"sensor string, days int, app string, {_SHARE}",
    "app_usage": f"sensor string, applicationname string, {_SHARE}",
    "manufacture_years": "sensor string, year int, count bigint",
    "models": "sensor string, model string, count bigint",
    "locations": "sensor string, location string, count bigint",
    "assets": (
        "sensor string, wguid string, manufacturer string, model string, hostname string, invoicedt timestamp, "
        "assetlocation string, loc_remark string, country string"
    ),
    "job_titles": "sensor string, jobtitle string, count bigint, rank int",
    "health": "sensor string, days int, rank int, health_score string, machine_count bigint",
    "health_members": "sensor string, days int, health_score string, wguid string",
    "silent_sensors": "sensor string, silent boolean",
}
