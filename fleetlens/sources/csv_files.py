"""CSV input, plain or gzip. A gzip file is one task, so it suits result files, not fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    *,
    timestamps: Sequence[str] = (),
    dates: Sequence[str] = (),
) -> DataFrame:
    """A CSV file with a header, with a schema or as text with the named time columns converted."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    for name in timestamps:
        df = df.withColumn(name, F.to_timestamp(name))
    for name in dates:
        df = df.withColumn(name, F.to_date(name))
    return df


def read_csv_checked(
    spark: SparkSession, path: str, schema: StructType | str, quarantine: str
) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV file that fit the schema, and counts ``file, rows`` of those that do not.

    A row with too few or too many fields, a bad number, date or time is not read as NULLs and does not end the job: its
    text goes to the Parquet folder ``quarantine`` as ``file, line``, which is replaced. The file is parsed once, into a
    folder beside, so that both parts are of the same reading; empty fields are NULL in either case.
    """
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken = {name.lower() for name in declared.names}
    line, file = (next(n for n in (name, f"_{name}", f"__{name}") if n not in taken) for name in ("line", "file"))
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", line)
    parsed = reader.schema(StructType([*declared.fields, StructField(line, StringType())])).csv(path)
    parsed.withColumn(file, F.input_file_name()).write.mode("overwrite").parquet(f"{quarantine}-parsed")
    rows = spark.read.parquet(f"{quarantine}-parsed")
    bad = rows.where(F.col(line).isNotNull()).select(F.col(file).alias("file"), F.col(line).alias("line"))
    bad.write.mode("overwrite").parquet(quarantine)
    counts = spark.read.schema("file string, line string").parquet(quarantine).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    return rows.where(F.col(line).isNull()).select(*declared.names), counts


def read_indexed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose first column is an unnamed row index; the index is dropped."""
    df = spark.read.option("header", True).csv(path)
    return df.drop(df.columns[0])
