"""What two machines share and where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import in_range
from fleetlens.functions.times import Moment
from fleetlens.sources.tables import Fleet

# Compared kind, its table, item column, counted column and time column.
KINDS = (
    ("sensor", "sensor_results_daily", "sensorname", "sensorsystemid", "resulttime"),
    ("software", "software", "packagename", "package_id", "installdate"),
    ("driver", "devices", "caption", "classguid", "adddate"),
    ("patch", "patches", "patchname", "patch_id", "installdate"),
    ("change", "changes_daily", "changedesc", "changeclass", "changetime"),
)


def machine_items(fleet: Fleet, start: Moment | None = None, end: Moment | None = None) -> DataFrame:
    """Items of all kinds as ``(kind, wguid, item, has_value)``; sensors exclude the lower bound itself."""
    parts = []
    for kind, table, item, value, time in KINDS:
        rows = in_range(fleet[table], time, start, end, lower_inclusive=kind != "sensor")
        parts.append(
            rows.select(
                F.lit(kind).alias("kind"),
                "wguid",
                F.col(item).alias("item"),
                F.col(value).isNotNull().alias("has_value"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def compare_machines(items: DataFrame, first: object, second: object) -> DataFrame:
    """``(kind, item, side)`` with side ``both``, ``first`` or ``second``.

    An item is shared if both machines have a row of it. On one side alone it must also have a
    row with a counted value.
    """
    rows = items.filter(F.col("wguid").isin(first, second) & F.col("item").isNotNull())

    def seen(machine: object) -> Column:
        return F.bool_or(F.col("wguid") == F.lit(machine))

    def valued(machine: object) -> Column:
        return F.bool_or((F.col("wguid") == F.lit(machine)) & F.col("has_value"))

    found = rows.groupBy("kind", "item").agg(
        seen(first).alias("in_first"),
        seen(second).alias("in_second"),
        valued(first).alias("first_valued"),
        valued(second).alias("second_valued"),
    )
    side = (
        F.when(F.col("in_first") & F.col("in_second"), F.lit("both"))
        .when(F.col("first_valued"), F.lit("first"))
        .when(F.col("second_valued"), F.lit("second"))
    )
    return found.select("kind", "item", side.alias("side")).filter(F.col("side").isNotNull())


def item_matrix(items: DataFrame, names: list[str]) -> DataFrame:
    """Rows with a value per machine (rows) and item (columns); NULL where the machine has no row."""
    counted = items.groupBy("wguid").pivot("item", names)
    return counted.agg(F.count(F.when(F.col("has_value"), F.lit(1))))
