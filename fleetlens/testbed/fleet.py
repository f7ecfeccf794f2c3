"""The driver's test tables in the shape of the fleet tables.

Machines are customers, sensors are event types, installed items are the parts of order lines.
Every fleet table is derived from whole test tables; ``oracle.py`` writes the same in SQL.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.schemas import TABLES
from fleetlens.sources.tables import Fleet

DOMAIN = ".FLEET.EXAMPLE"
USER_PREFIX = "CORP\\"

# Columns and types of the test tables.
_DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_DDL[name]).parquet(f"{sf_dir}/{name}.parquet")


def standin_fleet(spark: SparkSession, sf_dir: str) -> Fleet:
    """Each fleet table is set up when a query first asks for it."""

    @cache
    def table(name: str) -> DataFrame:
        return read_table(spark, sf_dir, name)

    @cache
    def results() -> DataFrame:
        initial = F.upper(F.substring("event_type", 1, 1))
        return table("events").select(
            F.col("user_id").alias("wguid"),
            F.concat(initial, F.lit("-"), F.col("user_id").cast("string")).alias("systemid"),
            F.get_json_object("props", "$.k").alias("sensorid"),
            F.col("event_type").alias("sensorname"),
            F.floor("value").cast("int").alias("severity"),
            F.col("ts").alias("resulttime"),
            F.col("props").alias("instancevalue"),
        )

    @cache
    def installs() -> DataFrame:
        """Order lines with their machine and item; each fleet table names the columns it uses.

        A task hashes its orders, which are few and have a key each, and does not sort its lines.
        """
        orders = table("orders").hint("shuffle_hash")
        lines = table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.join(table("part"), F.col("l_partkey") == F.col("p_partkey"))

    def items(**columns: str) -> DataFrame:
        named = [F.expr(source).alias(name) for name, source in columns.items()]
        return installs().select(F.col("o_custkey").alias("wguid"), *named)

    @cache
    def owned() -> DataFrame:
        return table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))

    def places() -> DataFrame:
        return table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    host = "concat('HOST-0', substring(c_name, 10, 9))"
    frames = {
        "sensor_results_raw": results,
        "sensor_results_daily": lambda: results().select(
            "wguid", "sensorname", F.col("systemid").alias("sensorsystemid"), "resulttime"
        ),
        "derived_sensors": lambda: table("orders").selectExpr(
            "o_custkey AS wguid",
            "concat(o_orderstatus, '-', CAST(o_custkey AS STRING)) AS sensorsystemid",
            "CAST(NULL AS STRING) AS sensorid",
            "o_orderpriority AS sensorname",
            "CAST(floor(o_totalprice / 10000) AS INT) AS severity",
            "o_orderdate AS resulttime",
            "o_orderstatus AS instancevalue",
        ),
        "system_config": lambda: table("customer").selectExpr(
            "c_custkey AS wguid",
            f"concat({host}, '{DOMAIN}') AS systemid",
            "CAST(round((c_acctbal + 1000) * 100) AS BIGINT) * 1000 AS totalphysicalmemory",
            "concat('Maker-', CAST(c_nationkey AS STRING)) AS manufacturer",
            "c_mktsegment AS model",
        ),
        "sensor_information": lambda: table("nation").selectExpr(
            "CAST(n_nationkey AS STRING) AS ruleid",
            "CAST(n_regionkey AS STRING) AS sensorcategory",
            "n_name AS description",
        ),
        "user_info": lambda: table("customer").select(
            F.col("c_custkey").alias("wguid"),
            F.expr(f"concat({host}, '{DOMAIN}') AS systemid"),
            F.concat(F.lit(USER_PREFIX), F.col("c_name")).alias("username"),
        ),
        "patches": lambda: items(
            patch_id="CAST(l_partkey AS STRING)", patchname="p_name", installdate="l_shipdate"
        ),
        "controllers": lambda: items(
            caption="p_type", manufacturer="p_brand", devicestatus="l_linestatus", datemodified="l_shipdate"
        ),
        "software": lambda: items(
            packagename="p_type",
            package_id="CAST(l_partkey AS STRING)",
            version="p_brand",
            installdate="l_shipdate",
        ),
        "software_changes": lambda: items(software="p_type", newversion="p_brand", changetime="l_shipdate"),
        "bios": lambda: owned().selectExpr(
            "o_custkey AS wguid",
            "o_orderpriority AS name",
            "CAST(date_trunc('year', o_orderdate) AS DATE) AS date",
        ),
        "app_faults": lambda: table("events").selectExpr(
            "user_id AS wguid",
            "ts AS vwtime",
            "event_type AS appname",
            "substring(get_json_object(props, '$.k'), 1, 1) AS appver",
        ),
        "app_usage": lambda: items(
            applicationname="p_name", starttime="o_orderdate", endtime="l_shipdate"
        ),
        "users": lambda: table("customer").selectExpr(
            "c_custkey AS wguid",
            "c_name AS systemid",
            "concat('Title ', CAST(c_nationkey AS STRING)) AS jobtitle",
        ),
        "directory_computers": lambda: owned().selectExpr("c_name AS name", "o_orderdate AS createddate"),
        "assets": lambda: owned().selectExpr(
            f"{host} AS hostname", "o_orderdate AS invoicedt", "c_nationkey AS assetlocation"
        ),
        "locations": lambda: places().selectExpr(
            "n_nationkey AS loc_id", "concat('SITE-', n_name, '-A') AS loc_remark", "r_name AS country"
        ),
        "health_daily": lambda: table("events").selectExpr(
            "user_id AS wguid",
            "ts AS vwtime",
            "value * 1.8D AS wscore",
            "CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS activestatus",
        ),
        "devices": lambda: items(caption="p_brand", classguid="p_type", adddate="l_shipdate"),
        "changes_daily": lambda: items(
            changedesc="CAST(p_size AS STRING)", changeclass="p_type", changetime="l_shipdate"
        ),
        "sensor_definitions": lambda: places().selectExpr("n_name AS sensorname", "r_name AS description"),
    }
    return Fleet(spark, frames=frames)


def order_fleet(fleet: Fleet) -> Fleet:
    """The same tables with the derived sensors (order priorities) as daily results.

    They cover the years of the installed items; the events cover one later month.
    """
    frames = {name: (lambda name=name: fleet[name]) for name in TABLES}
    frames["sensor_results_daily"] = lambda: fleet["derived_sensors"].select(
        "wguid", "sensorname", "sensorsystemid", "resulttime"
    )
    return Fleet(fleet.spark, frames=frames)


def uploaded_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as an uploaded host list; the names are longer than a stored host name."""
    supplier = read_table(spark, sf_dir, "supplier")
    return supplier.select(F.concat(F.lit("HOST-0"), F.substring("s_name", 10, 9), F.lit("-DOCK")).alias("name"))


def uploaded_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as an uploaded user list, some with and some without the prefix."""
    supplier = read_table(spark, sf_dir, "supplier")
    bare = F.concat(F.lit("Customer#"), F.substring("s_name", 10, 9))
    prefixed = F.concat(F.lit(USER_PREFIX), bare)
    return supplier.select(F.when(F.col("s_acctbal") > 0, bare).otherwise(prefixed).alias("name"))
