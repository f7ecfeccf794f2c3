"""Published runs: a run writes its datasets to a folder of its own, and one small file makes all of it visible.

``root/runs/<run>`` holds the datasets of a run, ``root/manifest`` one file per published run with a row per sensor.
The file is written by a single task when everything else is stored, so that a reader sees a whole run or none of it.
A run that was stopped is named nowhere: its folder can be deleted at any time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.functions import day_start
from fleetlens.functions.times import Moment
from fleetlens.schemas import REPORT_SCHEMAS
from fleetlens.sinks.datasets import read_dataset

MANIFEST = "number long, whole boolean, run string, as_of date, sensor string"


def new_run(root: str, as_of: Moment) -> tuple[str, str]:
    """A name for a run, and the folder that is its own."""
    run = f"{day_start(as_of).date()}-{uuid.uuid4().hex}"
    return run, f"{root}/runs/{run}"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``number, whole, run, as_of, sensor`` of all published runs; no rows before the first one."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(sensors: DataFrame, root: str, run: str, as_of: Moment, *, whole: bool = True) -> None:
    """Makes a run visible for its sensors. A ``whole`` run also ends what earlier runs hold of other sensors."""
    known = manifest(sensors.sparkSession, root).agg(F.max("number")).first()[0]
    rows = sensors.select("sensor").distinct().select(
        F.lit((known or 0) + 1).cast("long").alias("number"),
        F.lit(whole).alias("whole"),
        F.lit(run).alias("run"),
        F.lit(day_start(as_of).date()).alias("as_of"),
        "sensor",
    )
    rows.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def live(spark: SparkSession, root: str) -> DataFrame:
    """``sensor, run, as_of``: the run that holds each sensor now."""
    rows = manifest(spark, root)
    last = rows.where("whole").agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    newest = rows.crossJoin(F.broadcast(last)).where("number >= last")  # one row
    return newest.groupBy("sensor").agg(F.max_by(F.struct("run", "as_of"), "number").alias("of")).select("sensor", "of.run", "of.as_of")


def unpublished(catalogue: DataFrame, root: str, as_of: Moment) -> DataFrame:
    """Sensors of the catalogue without a published run of this day or a later one."""
    done = live(catalogue.sparkSession, root).where(F.col("as_of") >= F.lit(day_start(as_of).date()))
    return catalogue.select("sensor").join(done.select("sensor"), "sensor", "left_anti")


def runs_of(spark: SparkSession, root: str) -> list[tuple[str, date, list[str]]]:
    """Run, day and sensors of each run that holds any now: names of the caller's catalogue, not data."""
    rows = live(spark, root).groupBy("run", "as_of").agg(F.sort_array(F.collect_list("sensor")).alias("sensors")).collect()
    return sorted((row.run, row.as_of, row.sensors) for row in rows)


def read_published(
    spark: SparkSession, root: str, schemas: Mapping[str, StructType | str], sensors: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Datasets as the runs hold them that are published now, all by the same state of the manifest."""
    runs = runs_of(spark, root)
    found = {}
    for name, declared in schemas.items():
        schema = StructType.fromDDL(declared) if isinstance(declared, str) else declared
        parts = []
        for run, _, held in runs:
            wanted = held if sensors is None else sorted(set(held) & set(sensors))
            if wanted:
                part = read_dataset(spark, f"{root}/runs/{run}", name, schema)
                parts.append(part.where(F.col("sensor").isin(wanted)))
        found[name] = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return found


def read_report(
    spark: SparkSession, root: str, sensors: Sequence[str] | None = None, datasets: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """The published datasets of a report, of the wanted sensors only; their schemas are declared, not inferred."""
    return read_published(spark, root, {name: REPORT_SCHEMAS[name] for name in datasets or REPORT_SCHEMAS}, sensors)
