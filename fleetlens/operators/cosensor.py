"""Sensors that fire together on one machine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.sinks import settle

PAIR_KEYS = ("wguid", "sensorsystemid", "resulttime")


def pair_sides(pair: str) -> tuple[str, str]:
    """The two sensors of a name written ``A:B``."""
    names = pair.split(":")
    if len(names) != 2 or names[0] == names[1] or "" in names:
        raise ValueError(f"a pair names two different sensors as 'A:B', not {pair!r}")
    return names[0], names[1]


def _sides(pairs: Sequence[str]) -> Column:
    """A constant map: sensor -> its ``(pair, side)`` entries among the wanted pairs (side 1 or 2)."""
    entries: dict[str, list[Column]] = {}
    for pair in dict.fromkeys(pairs):
        for side, name in enumerate(pair_sides(pair), start=1):
            entries.setdefault(name, []).append(F.struct(F.lit(pair).alias("pair"), F.lit(side).alias("side")))
    cells = [cell for name, sides in entries.items() for cell in (F.lit(name), F.array(*sides))]
    return F.create_map(*cells)


def cosensor_results(results: DataFrame, pairs: Sequence[str], *, keys: Sequence[str] = PAIR_KEYS) -> DataFrame:
    """One row ``(keys..., sensor="A:B")`` wherever both sensors of a wanted pair share the keys.

    A pair is returned as it is written, also if it is wanted in both orders.

    A row only stands for the pairs that were asked for, and a group is reduced to one bit per
    side before the shuffle. No group's combinations are listed, however many rows it has.
    """
    present = results.dropna(subset=[*keys, "sensor"])
    hits = F.explode(F.try_element_at(_sides(pairs), "sensor"))
    sides = present.select(*keys, hits.alias("hit")).select(*keys, "hit.pair", "hit.side")
    both = sides.groupBy(*keys, "pair").agg(F.bit_or("side").alias("found")).filter(F.col("found") == 3)
    return both.select(*keys, F.col("pair").alias("sensor"))


def frequent_pairs(results: DataFrame, least: int, *, keys: Sequence[str] = PAIR_KEYS, folder: str | None = None) -> DataFrame:
    """``(sensor="A:B", groups)``: all pairs of sensors, A before B, that share at least ``least`` groups of equal keys.

    A pair can only share as many groups as the rarer of its sensors has, so sensors of fewer groups are left out before
    any pair is formed (their number of groups is counted first). Of a group, the sensors that are left are kept as one
    sorted list, equal lists are counted together, and pairs are formed once per distinct list: a thousand groups with
    the same many sensors list their combinations once. Rows repeat without effect; rows without a sensor or a key do
    not count. ``folder`` as in ``sinks.settle``, for the distinct rows.
    """
    if least < 1:
        raise ValueError("a pair shares one group at least")
    present = settle(results.dropna(subset=[*keys, "sensor"]).select(*keys, "sensor").distinct(), folder)
    support = present.groupBy("sensor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("sensor")
    lists = present.join(support, "sensor").groupBy(*keys).agg(F.sort_array(F.collect_set("sensor")).alias("sensors"))
    # As long as the catalogue of sensors at most, however many rows a group has.
    counted = lists.where(F.size("sensors") > 1).groupBy("sensors").agg(F.count(F.lit(1)).alias("groups"))
    left = counted.select("sensors", "groups", F.posexplode("sensors").alias("at", "left"))
    others = F.slice("sensors", F.col("at") + 2, F.size("sensors"))
    pairs = left.select("left", F.explode(others).alias("right"), "groups").groupBy("left", "right").agg(F.sum("groups").alias("groups"))
    found = pairs.where(F.col("groups") >= least)
    return found.select(F.concat_ws(":", "left", "right").alias("sensor"), "groups")


def frequent_cosensor_results(
    results: DataFrame, least: int, *, keys: Sequence[str] = PAIR_KEYS, folder: str | None = None
) -> DataFrame:
    """``cosensor_results`` of all frequent pairs, which are names of the catalogue: one row per pair and shared group."""
    pairs = sorted(row.sensor for row in frequent_pairs(results, least, keys=keys, folder=folder).collect())
    if not pairs:
        return results.select(*keys, "sensor").limit(0)
    return cosensor_results(results, pairs, keys=keys)
