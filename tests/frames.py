"""Small hand-written fleet tables."""

from __future__ import annotations

from datetime import date, datetime

from fleetlens.schemas import schema
from fleetlens.sources.tables import Fleet


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def day(text: str) -> date:
    return date.fromisoformat(text)


def make(spark, table: str, rows: list[dict]):
    kind = schema(table)
    return spark.createDataFrame([tuple(row.get(f.name) for f in kind.fields) for row in rows], kind)


def fleet(spark, **tables: list[dict]) -> Fleet:
    return Fleet(spark, frames={name: make(spark, name, rows) for name, rows in tables.items()})


def cohort(spark, machines, sensor: str = "S"):
    return spark.createDataFrame([(sensor, m) for m in machines], "sensor string, wguid string")


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
