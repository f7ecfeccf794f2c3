"""Sensor catalogue and uploaded name lists. The names are deployment data and come from the caller."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.labels import is_pair

_ONE_COLUMN = "name string"


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded list: one column, no header, duplicates removed."""
    return spark.read.schema(_ONE_COLUMN).csv(path).distinct()


def read_sensor_names(spark: SparkSession, path: str) -> DataFrame:
    """Sensor names, one per line. Blanks belong to the name, also at the end."""
    lines = spark.read.text(path).filter(F.col("value") != "")
    return lines.select(F.col("value").alias("sensor")).distinct()


def catalogue_frame(spark: SparkSession, sensors: Iterable[str]) -> DataFrame:
    """``(sensor, is_pair, left, right)`` of the given names."""
    names = spark.createDataFrame([(s,) for s in dict.fromkeys(sensors)], "sensor string")
    colon = F.contains("sensor", F.lit(":"))
    return names.select(
        "sensor",
        colon.alias("is_pair"),
        F.when(colon, F.split_part("sensor", F.lit(":"), F.lit(1))).alias("left"),
        F.when(colon, F.split_part("sensor", F.lit(":"), F.lit(2))).alias("right"),
    )


def pair_members(pairs: Sequence[str]) -> list[str]:
    """The distinct sensor names that take part in the pairs."""
    return sorted({name for pair in pairs if is_pair(pair) for name in pair.split(":")})
