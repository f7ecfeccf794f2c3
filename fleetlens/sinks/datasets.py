"""Result tables on shared storage, partitioned by sensor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def write_dataset(df: DataFrame, root: str, name: str, *, replace_all: bool = True) -> None:
    """Writes a dataset under ``root/name``, one Parquet partition per sensor.

    ``replace_all`` drops what an earlier run left; otherwise only the sensors in ``df`` are
    replaced. The rebalance hint gives small sensors one file each and, as AQE splits large
    partitions, does not send a dominant sensor through one task.
    """
    mode = "static" if replace_all else "dynamic"
    writer = df.hint("rebalance", "sensor").write.mode("overwrite").partitionBy("sensor")
    writer.option("partitionOverwriteMode", mode).parquet(f"{root}/{name}")


def read_dataset(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """Reads a written dataset. The declared schema keeps sensor names as text, blanks included."""
    fields = [f for f in schema.fields if f.name != "sensor"]
    declared = StructType([*fields, StructField("sensor", StringType())])
    stored = spark.read.schema(declared).parquet(f"{root}/{name}")
    return stored.select(*schema.names)


def write_csv(df: DataFrame, path: str, *, time_format: str = "yyyy-MM-dd HH:mm:ss") -> None:
    """Gzip CSV with a header, for download. One file per task; order rows before if it matters."""
    writer = df.write.mode("overwrite").option("header", True).option("compression", "gzip")
    # Quoted blanks survive reading; without these options a reader would trim names.
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("timestampFormat", time_format).option("timestampNTZFormat", time_format).csv(path)


def settle(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a frame to a shared folder and reads it back.

    For a cohort that several datasets use: its plan runs once, and Spark then knows its true size. ``folder``
    belongs to the caller, who deletes it when the job is over; without it, the frame goes to
    ``spark.checkpoint.dir``, which all executors have to share.
    """
    spark = df.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("name a folder that all executors share, or set spark.checkpoint.dir")
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Names a frame for SQL in this session, replacing an earlier one of that name."""
    df.createOrReplaceTempView(name)
    return df
