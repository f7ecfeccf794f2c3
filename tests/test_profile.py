import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetlens.functions import percent_change, percentage
from fleetlens.operators import compare, health, profile
from fleetlens.plans import moving, reports
from fleetlens.sources import Fleet
from pyspark.sql import functions as F
from frames import at, cohort, day, fleet, rows


def assets_fleet(spark):
    return fleet(
        spark,
        system_config=[
            {"wguid": "a", "systemid": "h1.x.y", "manufacturer": "M", "model": "L1"},
            {"wguid": "b", "systemid": "h2", "manufacturer": "M", "model": None},
            {"wguid": "b", "systemid": "h1.other", "manufacturer": "M", "model": "L2"},
        ],
        assets=[
            {"hostname": "h1", "invoicedt": at("2020-05-01"), "assetlocation": "p"},
            {"hostname": "h1", "invoicedt": None, "assetlocation": "q"},
            {"hostname": "h2", "invoicedt": at("2021-05-01"), "assetlocation": None},
        ],
        locations=[
            {"loc_id": "p", "loc_remark": "S-PARIS-1", "country": "FR"},
            {"loc_id": "p", "loc_remark": "S-PARIS-2", "country": "FR"},
            {"loc_id": "q", "loc_remark": "nowhere", "country": "FR"},
        ],
    )


def test_counts_equal_counts_of_the_joined_rows(spark):
    tables, machines = assets_fleet(spark), cohort(spark, ["a", "b"])
    joined = profile.asset_info(tables, machines).collect()
    assert len(joined) == 7  # h1: two location rows of p, one of q, for a and b; h2 once
    assert rows(profile.manufacture_year_counts(tables, machines)) == [("S", 2020, 4), ("S", 2021, 1)]
    assert rows(profile.model_counts(tables, machines)) == [("S", "L1", 3), ("S", "L2", 3)]
    assert rows(profile.location_counts(tables, machines)) == [("S", "PARIS,FR", 4)]  # no second part, no city


def test_drilldown_members(spark):
    tables, machines = assets_fleet(spark), cohort(spark, ["a", "b"])
    assert rows(profile.machines_with(tables, machines, year=2021)) == [("S", "b")]
    assert rows(profile.machines_with(tables, machines, model="L1")) == [("S", "a")]
    ranged = machines.selectExpr("*", "date'2024-06-01' AS date_from", "date'2024-06-30' AS date_to")
    assert rows(profile.machines_with(tables, ranged, model="L1")) == [("S", "a", day("2024-06-01"), day("2024-06-30"))]


def test_drilldown_keeps_the_range_of_a_sensor(spark):
    config = [{"wguid": m, "systemid": f"{m}.x", "model": "L1"} for m in "ab"]
    patches = [
        {"wguid": "a", "patchname": "January", "installdate": at("2024-01-15 00:00:00")},
        {"wguid": "a", "patchname": "June", "installdate": at("2024-06-15 00:00:00")},
    ]
    tables = fleet(spark, system_config=config, patches=patches, assets=[{"hostname": "a"}, {"hostname": "a.x"}])
    ranged = cohort(spark, ["a"]).selectExpr("*", "date'2024-06-01' AS date_from", "date'2024-06-30' AS date_to")
    bounds = ("2024-01-01", "2024-12-31", "2024-12-31")
    part = reports.drilldown(tables, ranged, *bounds, model="L1", datasets=["patches"])["patches"]
    whole = reports.cohort_report(tables, ranged, *bounds, datasets=["patches"])["patches"]
    assert rows(part) == rows(whole) == [("S", "June", 100.0)]


def test_sorted_counts(spark):
    counts = spark.createDataFrame([("S", "a", 1), ("S", "b", 3), ("S", "c", 3)], "sensor string, model string, count int")
    assert [r.model for r in profile.sorted_counts(counts, "model").collect()] == ["b", "c", "a"]


def test_job_titles(spark):
    tables = fleet(
        spark,
        users=[{"wguid": "a", "systemid": "h1", "jobtitle": "T"}, {"wguid": "b", "systemid": "h2", "jobtitle": None},
               {"wguid": "c", "systemid": "gone", "jobtitle": "T"}],
        directory_computers=[{"name": "h1"}, {"name": "h1"}, {"name": "h2"}],
    )
    assert rows(profile.top_job_titles(tables, cohort(spark, "abc"))) == [("S", "T", 2, 1)]


@pytest.mark.parametrize(
    "counts, expected",
    [
        ({"a": 90, "b": 8, "c": 2}, {"a": 90, "b": 8, "Other": 2}),
        ({"a": 90, "b": 10}, {"a": 90, "b": 10, "Other": 0}),
        ({"a": 95, "b": 5}, {"a": 95, "b": 5, "Other": 0}),
        ({"a": 90, "b": 4, "c": 4, "d": 2}, {"a": 90, "Other": 10}),
    ],
)
def test_share_with_other(spark, counts, expected):
    df = spark.createDataFrame([("S", k, n) for k, n in counts.items()], "sensor string, model string, count long")
    found = {r.label: r.value for r in profile.share_with_other(df, "model").collect()}
    assert found == expected and sum(found.values()) == sum(counts.values())


def test_health(spark):
    scores = {"a": 0.0, "b": 80.0, "c": 80.1, "d": 97.0, "e": 97.1, "f": 50.0, "x": 90.0}
    table = [{"wguid": m, "vwtime": at("2024-01-29"), "wscore": v, "activestatus": 1} for m, v in scores.items()]
    table.append({"wguid": "b", "vwtime": at("2024-01-10"), "wscore": 100.0, "activestatus": 1})
    table.append({"wguid": "f", "vwtime": at("2024-01-29"), "wscore": 100.0, "activestatus": 0})
    tables, machines = fleet(spark, health_daily=table), cohort(spark, "abcdef")
    summary = health.health_summary(tables, machines, "2024-01-30")
    assert rows(summary.select("days", "rank", "health_score", "machine_count")) == [
        (30, 1, "Poor", 1),
        (30, 2, "Fair", 2),
        (30, 3, "Good", 1),
        (30, 4, "Excellent", 1),
        (7, 1, "Poor", 2),
        (7, 2, "Fair", 1),
        (7, 3, "Good", 1),
        (7, 4, "Excellent", 1),
    ]
    poor = health.health_members(tables, machines, "2024-01-30").filter("days = 7 AND health_score = 'Poor'")
    assert rows(poor.select("wguid")) == [("b",), ("f",)]
    nobody = health.health_summary(tables, cohort(spark, ["z"]), "2024-01-30")
    assert [r.machine_count for r in nobody.collect()] == [0] * 8


# Their products with 1.8 add up to 12 times 90; added as doubles, their mean is 90.00000000000001.
ON_THE_EDGE = [64.11, 39.78, 13.14, 40.52, 12.76, 68.42, 82.04, 2.75, 2.21, 16.34, 92.28, 165.65]


def test_health_on_the_edge(spark):
    table = [
        {"wguid": m, "vwtime": at("2024-01-29"), "wscore": v * 1.8, "activestatus": 1}
        for m, scores in (("a", ON_THE_EDGE), ("b", sorted(ON_THE_EDGE)), ("c", ON_THE_EDGE[::-1]))
        for v in scores
    ]
    others = {"d": [float("inf"), 1.0], "e": [1e-14], "f": [None], "g": [90.000000001], "h": [1e300, 2.0], "i": [float("nan")]}
    table += [{"wguid": m, "vwtime": at("2024-01-29"), "wscore": v, "activestatus": 1} for m, vs in others.items() for v in vs]
    for parts in (1, 5):
        facts = fleet(spark, health_daily=table)["health_daily"].repartition(parts)
        found = health.machine_health(Fleet(spark, frames={"health_daily": facts}), "2024-01-30")
        kinds = {r.wguid: r.category_30 for r in found.collect()}
        assert kinds == dict.fromkeys("abc", "Fair") | {"d": "Excellent", "e": "Poor", "f": None, "g": "Good", "h": "Excellent", "i": None}


def test_merged_health_on_the_edge(spark):
    days = [f"2024-01-{d}" for d in range(18, 30)]
    table = [
        {"wguid": m, "vwtime": at(d), "wscore": v * 1.8, "activestatus": 1}
        for turn, m in enumerate("abcdefghijkl")
        for d, v in zip(days, ON_THE_EDGE[turn:] + ON_THE_EDGE[:turn], strict=True)
    ]
    kept = moving.MOVING["health"].days(fleet(spark, health_daily=table)["health_daily"])

    def kinds(parts):
        scores = moving.window_scores(parts.repartition(3), day("2024-01-30"))
        return {r.wguid: r.category_30 for r in health.score_categories(scores).collect()}

    assert kinds(kept) == dict.fromkeys("abcdefghijkl", "Fair")
    # Days of an earlier version are read as they were.
    blank = {c: F.lit(None).cast(kept.schema[c].dataType) for c in ("exact", "n_exact")}
    old = F.col("day") < F.lit(day("2024-01-20"))
    mixed = kept.where(~old).unionByName(kept.where(old).withColumns(blank))
    assert all(kind in ("Fair", "Good") for kind in kinds(mixed).values())


def test_compare(spark):
    def software(wguid, name, package_id="1"):
        return {"wguid": wguid, "packagename": name, "package_id": package_id, "installdate": at("2024-01-02")}

    tables = fleet(
        spark,
        software=[
            software("a", "both"),
            software("b", "both", None),
            software("a", "first"),
            software("a", "first, no value", None),
            software("b", "second"),
            software("b", None),
            software("c", "third machine"),
        ],
        sensor_results_daily=[
            {"wguid": "a", "sensorname": "on the bound", "sensorsystemid": "w", "resulttime": at("2024-01-01")},
            {"wguid": "a", "sensorname": "inside", "sensorsystemid": "w", "resulttime": at("2024-01-01 00:00:01")},
        ],
        devices=[],
        patches=[],
        changes_daily=[],
    )
    items = compare.machine_items(tables, "2024-01-01", "2024-01-03")
    assert rows(compare.compare_machines(items, "a", "b")) == [
        ("sensor", "inside", "first"),
        ("software", "both", "both"),
        ("software", "first", "first"),
        ("software", "second", "second"),
    ]
    one_sided = rows(compare.compare_machines(items, "c", "nobody"))
    assert one_sided == [("software", "third machine", "first")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("uvwxyz")), max_size=15))
def test_compare_splits_the_items(spark, pairs):
    items = spark.createDataFrame(
        [("software", m, i, True) for m, i in pairs], "kind string, wguid string, item string, has_value boolean"
    )
    found = {r.item: r.side for r in compare.compare_machines(items, "a", "b").collect()}
    of = {machine: {i for m, i in pairs if m == machine} for machine in "ab"}
    assert {i for i, side in found.items() if side in ("both", "first")} == of["a"]
    assert {i for i, side in found.items() if side in ("both", "second")} == of["b"]


def test_change_rules(spark):
    pairs = [(0.0, 0.0), (5.0, 0.0), (0.0, 5.0), (5.0, 4.0), (201.0, 200.0), (2.5, 1.0)]
    df = spark.createDataFrame(pairs, "now double, before double")
    found = [r[0] for r in df.select(percent_change(F.col("now"), F.col("before"))).collect()]
    assert found == [None, 100, -100, 25, 0, 150]
    assert spark.range(1).select(percentage(F.lit(1), F.lit(0))).first()[0] is None
