"""Where the fleet tables are: a catalogue database, a folder of Parquet files, or given frames.

A frame may be given as a function; it is called when the table is first used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from fleetlens.schemas import TABLES, schema


class Fleet:
    """Lazy access to the source tables by name.

    >>> fleet = Fleet(spark, database="telemetry")
    >>> fleet["patches"]
    """

    def __init__(
        self,
        spark: SparkSession,
        *,
        database: str | None = None,
        root: str | None = None,
        frames: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None,
    ):
        self.spark = spark
        self._database = database
        self._root = root
        self._frames = dict(frames or {})

    def __getitem__(self, table: str) -> DataFrame:
        frame = self._frames.get(table)
        if frame is not None:
            if not isinstance(frame, DataFrame):
                frame = self._frames[table] = frame()
            return frame
        if table not in TABLES:
            raise KeyError(f"unknown table {table!r}; known: {', '.join(TABLES)}")
        if self._database:
            return self.spark.table(f"{self._database}.{table}")
        if self._root:
            return self.spark.read.schema(schema(table)).parquet(f"{self._root}/{table}")
        raise KeyError(f"table {table!r} is neither given as a frame nor covered by a database or root")

    def restricted(self, machines: DataFrame) -> Fleet:
        """The same tables with only the rows of the given machines, where a table names machines.

        For cohorts that hold a small part of the fleet, which the caller knows: the semi join reaches the
        scans, so that rows of other machines are not reduced first. With large cohorts it would shuffle every
        raw row; leave it out there.
        """
        wanted = machines.select("wguid").distinct()

        def part(table: str) -> Callable[[], DataFrame]:
            return lambda: self[table].join(wanted, "wguid", "left_semi").select(*self[table].columns)

        known = self._frames if self._frames and not (self._database or self._root) else TABLES
        machine_tables = [t for t in known if t in TABLES and "wguid" in schema(t).fieldNames()]
        others = {t: (lambda t=t: self[t]) for t in known if t not in machine_tables}
        return Fleet(self.spark, frames={t: part(t) for t in machine_tables} | others)

    def sql(self, text: str) -> DataFrame:
        """A scan written as SQL over the session's catalogue; lazy like every other."""
        return self.spark.sql(text)
