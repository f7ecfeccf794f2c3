import collections
import random
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.functions import count_upto, latest_per
from fleetlens.operators import presence as p
from fleetlens.sinks import settle
from frames import at, cohort, day, fleet, rows


def patch(wguid, name, time="2024-01-02 05:00:00"):
    return {"wguid": wguid, "patchname": name, "installdate": at(time)}


def test_denominator_is_machines_with_rows(spark):
    tables = fleet(spark, patches=[patch("a", "P"), patch("b", "Q"), patch("x", "P")])
    machines = cohort(spark, ["a", "b", "without rows"])
    found = p.patch_presence(tables, machines, threshold=0)
    assert rows(found) == [("S", "P", 50.0), ("S", "Q", 50.0)]
    assert rows(p.patch_presence(tables, machines)) == []  # exactly 50 is not above 50


def test_repeated_rows_pass_one_hundred(spark):
    tables = fleet(spark, patches=[patch("a", "P")] * 3)
    machines = cohort(spark, ["a"])
    assert rows(p.patch_presence(tables, machines)) == [("S", "P", 300.0)]
    assert rows(p.patch_presence(tables, machines, mode="machines")) == [("S", "P", 100.0)]


def test_null_keys(spark):
    tables = fleet(
        spark,
        patches=[patch("a", None), patch("b", None)],
        bios=[{"wguid": "a", "name": None, "date": None}, {"wguid": "b", "name": "N", "date": day("2020-01-01")}],
    )
    machines = cohort(spark, ["a", "b"])
    assert rows(p.patch_presence(tables, machines)) == [("S", " ", 100.0)]
    assert rows(p.bios_presence(tables, machines)) == [
        ("S", " ", None, 50.0),
        ("S", "N", day("2020-01-01"), 50.0),
    ]


def test_latest_change_with_ties(spark):
    def change(version, time):
        return {"wguid": "a", "software": "X", "newversion": version, "changetime": at(time)}

    table = [
        change("1", "2024-01-02 05:00:00"),
        change("3", "2024-01-03 05:00:00"),
        change("2", "2024-01-03 05:00:00"),
    ]
    found = p.software_change_presence(fleet(spark, software_changes=table), cohort(spark, ["a"]))
    assert rows(found) == [("S", "X", "3", 100.0)]


def test_fault_windows(spark):
    def fault(wguid, app, version, time):
        return {"wguid": wguid, "appname": app, "appver": version, "vwtime": at(time)}

    table = [
        fault("a", "X", "1", "2024-01-20 00:00:00"),  # newest X of a: ten days old
        fault("a", "X", "2", "2024-01-10 00:00:00"),
        fault("b", "Y", None, "2024-01-29 00:00:00"),  # NULL version: the label is one blank
        fault("b", "Z", "1", "2024-01-29 00:00:00"),
        fault("b", "Z", "0", "2023-12-01 00:00:00"),  # before the 30 days
        fault("c", "X", "1", "2024-01-31 00:00:00"),  # the day after as_of begins here
        fault("c", "X", "9", "2024-01-31 00:00:01"),  # after the upper bound
    ]
    tables, machines = fleet(spark, app_faults=table), cohort(spark, ["a", "b", "c"])
    whole = rows(p.app_fault_presence(tables, machines, "2024-01-30 12:00:00"))
    assert whole == [
        ("S", 30, " ", 100 / 3),
        ("S", 30, "X 1", 200 / 3),
        ("S", 30, "Z 1", 100 / 3),
        ("S", 7, " ", 50.0),
        ("S", 7, "X 1", 50.0),
        ("S", 7, "Z 1", 50.0),
    ]
    only_a = p.app_fault_presence(tables, cohort(spark, ["a"]), "2024-01-30 12:00:00")
    assert rows(only_a) == [("S", 30, "X 1", 100.0)]
    assert rows(p.same_length_faults(only_a)) == []  # nothing in 7 days, so the display list is cut to nothing


def test_usage_counts_a_machine_once(spark):
    def use(wguid, app, end):
        return {"wguid": wguid, "applicationname": app, "starttime": at("2024-01-02 05:00:00"), "endtime": end}

    table = [use("a", "X", at("2024-01-02 06:00:00")), use("a", "X", None), use("b", "Y", None)]
    tables = fleet(spark, app_usage=table)
    assert rows(p.app_usage_presence(tables, cohort(spark, ["a", "b"]), threshold=0)) == [
        ("S", "X", 50.0),
        ("S", "Y", 50.0),
    ]


def test_own_ranges_per_sensor(spark):
    table = [
        patch("a", "P", "2024-01-02 00:00:00"),
        patch("a", "P", "2024-01-03 00:00:00"),
        patch("a", "Q", "2024-01-03 00:00:01"),
        patch("b", "Q", "2024-01-04 10:00:00"),
    ]
    changes = [
        {"wguid": "a", "software": "X", "newversion": v, "changetime": at(t)}
        for v, t in (("1", "2024-01-02 10:00:00"), ("2", "2024-01-03 00:00:00"), ("3", "2024-01-03 00:00:01"))
    ]
    tables = fleet(spark, patches=table, software_changes=changes)
    ranged = spark.createDataFrame(
        [(s, m, day("2024-01-02"), day(last)) for s, last in (("S", "2024-01-03"), ("T", "2024-01-05")) for m in "ab"],
        "sensor string, wguid string, date_from date, date_to date",
    )
    assert rows(p.patch_presence(tables, ranged, threshold=0)) == [
        ("S", "P", 200.0),
        ("T", "P", 100.0),
        ("T", "Q", 100.0),
    ]
    assert rows(p.software_change_presence(tables, ranged, threshold=0)) == [
        ("S", "X", "2", 100.0),
        ("T", "X", "3", 100.0),
    ]


def test_top_and_labels(spark):
    found = spark.createDataFrame(
        [("S", "a long package name", "1", 60.0), ("S", "b", None, 90.0), ("S", "c", "1", 60.0), ("T", "d", "2", 70.0)],
        "sensor string, packagename string, version string, system_percentage double",
    )
    top = p.top_presence(found, ["packagename", "version"], 2, short_from="packagename")
    assert rows(top) == [
        ("S", 1, "b ", "b...", 90.0),
        ("S", 2, "a long package name 1", "a long package ...", 60.0),
        ("T", 1, "d 2", "d...", 70.0),
    ]


def test_own_ranges_with_a_hot_machine(spark):
    """Half of the rows on one machine; both ways to join the ranges give what counting by hand gives."""
    draw = random.Random(11)
    when = [f"2024-01-{draw.randrange(1, 29):02d} {draw.choice(['00:00:00', '13:00:00'])}" for _ in range(1500)]
    table = [patch("m0" if draw.random() < 0.5 else f"m{draw.randrange(9)}", f"k{draw.randrange(25)}", t) for t in when]
    members = [
        (f"s{i}", f"m{m}", day(f"2024-01-{3 + i:02d}"), day(f"2024-01-{12 + i:02d}"))
        for i in range(6)
        for m in range(0, 9, 1 + i % 3)
    ]
    ranged = spark.createDataFrame(members, "sensor string, wguid string, date_from date, date_to date")
    expected = {}
    for sensor in {m[0] for m in members}:
        ranges = {m[1]: (at(f"{m[2]} 00:00:00"), at(f"{m[3]} 00:00:00")) for m in members if m[0] == sensor}
        hits = [
            (r["wguid"], r["patchname"])
            for r in table
            if r["wguid"] in ranges and ranges[r["wguid"]][0] <= r["installdate"] <= ranges[r["wguid"]][1]
        ]
        whole = len({m for m, _ in hits})
        for mode, counted in (("rows", hits), ("machines", set(hits))):
            for key, n in collections.Counter(k for _, k in counted).items():
                expected[mode, sensor, key] = n / whole * 100
    tables = fleet(spark, patches=table)
    for cohort_rows in (ranged, settle(ranged)):
        found = {
            (mode, r.sensor, r.patchname): r.system_percentage
            for mode in ("rows", "machines")
            for r in p.patch_presence(tables, cohort_rows, threshold=0, mode=mode).collect()
        }
        assert found == pytest.approx(expected)


def brute_force(facts, members, mode):
    result = {}
    for sensor in {s for s, _ in members}:
        machines = {m for s, m in members if s == sensor}
        hits = [(m, k) for m, k in facts if m in machines]
        whole = len({m for m, _ in hits})
        for key, n in collections.Counter(k for _, k in (hits if mode == "rows" else set(hits))).items():
            result[sensor, key] = n / whole * 100
    return result


@pytest.mark.parametrize("mode", ["rows", "machines"])
@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_hot_machine_sensor_and_key(spark, mode, limit):
    """A third of all rows on one machine, one key and one sensor; with and without broadcasts."""
    draw = random.Random(7)

    def name(letter, n):
        return f"{letter}0" if draw.random() < 0.34 else f"{letter}{draw.randrange(n)}"

    facts = [(name("m", 40), name("k", 60)) for _ in range(3000)]
    members = {(name("s", 20), f"m{draw.randrange(50)}") for _ in range(300)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        table = spark.createDataFrame(facts, "wguid string, key string").repartition(8)
        machines = spark.createDataFrame(sorted(members), "sensor string, wguid string")
        found = p.presence_pct(table, machines, ["key"], threshold=0, mode=mode).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = brute_force(facts, members, mode)
    assert {(r.sensor, r.key) for r in found} == set(expected)
    assert all(r.system_percentage == pytest.approx(expected[r.sensor, r.key]) for r in found)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("xyz")), min_size=1, max_size=20))
def test_machine_mode_is_a_share(spark, facts):
    table = spark.createDataFrame(facts, "wguid string, key string")
    found = p.presence_pct(table, cohort(spark, "abc"), ["key"], threshold=0, mode="machines").collect()
    assert all(0 < r.system_percentage <= 100 for r in found)


def test_latest_per(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, t int, v string")
    assert rows(latest_per(df, ["k"], "t", ["v"])) == [("a", 2, "y"), ("b", None, "z")]


@pytest.mark.parametrize("part", [7, 14, 28, 55, 56])
def test_a_share_equal_to_the_threshold_is_left_out(spark, part):
    facts = [(f"m{i}", "x" if i < part else f"other{i}") for i in range(100)]
    table = spark.createDataFrame(facts, "wguid string, key string")
    machines = cohort(spark, [f"m{i}" for i in range(100)])
    at_it = p.presence_pct(table, machines, ["key"], threshold=float(part))
    below = p.presence_pct(table, machines, ["key"], threshold=part - 0.5)
    assert rows(at_it) == [] and rows(below) == [("S", "x", float(part))]


def test_restricted_tables_give_the_same_report(spark):
    table = [patch(m, k, "2024-01-02 00:00:00") for m in "abcd" for k in ("x", "y" if m in "ab" else "z")]
    tables, machines = fleet(spark, patches=table), cohort(spark, ["a", "b"])
    few = tables.restricted(machines)
    assert {r.wguid for r in few["patches"].collect()} == {"a", "b"}
    assert few["patches"].columns == tables["patches"].columns
    whole = p.patch_presence(tables, machines, threshold=0)
    assert rows(p.patch_presence(few, machines, threshold=0)) == rows(whole)


def test_lookups_in_short_and_long_arrays(spark):
    arrays = [[], [4], list(range(0, 32, 2)), list(range(0, 2000, 3)), [7] * 40]
    asked = [-1, 0, 3, 4, 7, 30, 31, 1001, 1998, 5000]
    df = spark.createDataFrame([(a, x) for a in arrays for x in asked], "places array<int>, most int")
    for r in df.withColumn("n", count_upto(F.col("places"), F.col("most"))).collect():
        assert r.n == sum(p <= r.most for p in r.places)


def test_own_ranges_against_brute_force(spark):
    """Many days per machine and key, ranges that overlap, begin late, are one day long or hold nothing."""
    draw = random.Random(3)
    first = day("2024-01-01")
    facts = [
        (draw.choice("abc"), draw.choice(["P", "Q", None]), at(f"{first + timedelta(days=draw.randrange(40))} {draw.choice(['00:00:00', '09:00:00'])}"))
        for _ in range(400)
    ]
    ranges = {f"S{i}": (draw.randrange(-5, 45), draw.randrange(0, 30)) for i in range(12)} | {"one": (7, 0)}
    members = [
        (s, m, first + timedelta(days=a), first + timedelta(days=a + n)) for s, (a, n) in ranges.items() for m in "abcd" if draw.random() < 0.7
    ]
    frame = spark.createDataFrame(facts, "wguid string, patchname string, installdate timestamp")
    cohort_rows = spark.createDataFrame(members, "sensor string, wguid string, date_from date, date_to date")
    for mode in ("rows", "machines"):
        found = {(r.sensor, r.patchname): r.system_percentage for r in p.presence_pct(
            frame, cohort_rows, ["patchname"], threshold=0.0, mode=mode, time="installdate").collect()}
        wanted = {}
        for sensor in {s for s, *_ in members}:
            hits = [
                (m, key or " ") for s, own, a, b in members if s == sensor for m, key, t in facts
                if m == own and at(f"{a} 00:00:00") <= t <= at(f"{b} 00:00:00")
            ]
            machines = len({m for m, _ in hits})
            for key in {k for _, k in hits}:
                n = sum(k == key for _, k in hits) if mode == "rows" else len({m for m, k in hits if k == key})
                wanted[sensor, key] = 100.0 * n / machines
        assert found == pytest.approx(wanted)
