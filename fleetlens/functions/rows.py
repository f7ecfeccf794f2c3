"""Row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: Sequence[str], time: str, carry: Sequence[str] = ()) -> DataFrame:
    """The newest row of every key, with the carried columns; equal times: largest carried values, nulls last.

    Only the first row of each key leaves a map task (``WindowGroupLimit``), so a key that holds much of the table
    costs one row per map task.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in (time, *carry)])
    ranked = df.select(*keys, time, *carry).withColumn("_newest", F.row_number().over(newest))
    return ranked.filter(F.col("_newest") == 1).drop("_newest")
