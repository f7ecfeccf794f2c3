import os
import random
from datetime import timedelta

import pytest

from fleetlens.functions import file_key
from fleetlens.operators import cohort as c
from fleetlens.plans import anomaly_refresh, backfill, daily_refresh, moving_refresh, refresh, reports, stored_report
from fleetlens.plans.reports import DATASETS
from fleetlens.schemas import TABLES
from fleetlens.sinks import new_run, publish, publish_view, read_dataset, read_report, runs_of, settle, write_csv, write_dataset
from fleetlens.sources import (
    Fleet,
    catalogue_frame,
    read_csv,
    read_csv_checked,
    read_indexed_csv,
    read_name_list,
    read_sensor_names,
)
from frames import at, day, fleet, make, rows


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "out")


def test_sensor_names_survive_as_partitions(spark, root):
    names = ["plain", "trailing ", "A:B", "007", "50% a/b"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "sensor string, v int")
    write_dataset(df, root, "t")
    assert rows(read_dataset(spark, root, "t", df.schema)) == rows(df)


def test_overwriting_all_or_only_some_sensors(spark, root):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "sensor string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "sensor string, v int")
    write_dataset(old, root, "t")
    write_dataset(new, root, "t", replace_all=False)
    assert rows(read_dataset(spark, root, "t", old.schema)) == [("a", 1), ("b", 2), ("c", 2)]
    write_dataset(new, root, "t")
    assert rows(read_dataset(spark, root, "t", old.schema)) == [("b", 2), ("c", 2)]


def test_csv(spark, root):
    df = spark.createDataFrame(
        [("A ", "w,1", at("2024-01-02 03:04:05"))], "sensor string, systemid string, date timestamp"
    )
    write_csv(df, root)
    assert any(name.endswith(".csv.gz") for name in os.listdir(root))
    assert rows(read_csv(spark, root, df.schema)) == rows(df)
    assert rows(read_csv(spark, root, timestamps=["date"])) == rows(df)


def test_malformed_rows_are_kept_aside_and_counted(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("name,n,day,line\nx,1,2024-01-02,l\nshort,2\ny,many,2024-01-02,l\nz,3,2024-13-45,l\nw,,,\n")
    (folder / "b.csv").write_text("name,n,day,line\nlong,4,2024-01-03,l,more,fields\n\"a,b\",5,2024-01-04,l\n")
    good, bad = read_csv_checked(spark, str(folder), "name string, n int, day date, line string", str(tmp_path / "bad"))
    assert rows(good) == [("a,b", 5, day("2024-01-04"), "l"), ("w", None, None, None), ("x", 1, day("2024-01-02"), "l")]
    assert {r.file.rsplit("/", 1)[1]: r.rows for r in bad.collect()} == {"a.csv": 3, "b.csv": 1}
    kept = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted(r.line for r in kept.collect()) == ["long,4,2024-01-03,l,more,fields", "short,2", "y,many,2024-01-02,l", "z,3,2024-13-45,l"]
    (tmp_path / "fine.csv").write_text("name,n,day,line\nx,1,2024-01-02,l\n")
    good, bad = read_csv_checked(spark, str(tmp_path / "fine.csv"), "name string, n int, day date, line string", str(tmp_path / "none"))
    assert good.count() == 1 and bad.collect() == []


def test_lists(spark, tmp_path):
    (tmp_path / "names.csv").write_text("h1\nh2\nh1\n")
    (tmp_path / "sensors.txt").write_text("A \nB\n\n")
    (tmp_path / "indexed.csv").write_text(",A,B\n0,2024-01-01,\n1,2024-01-02,x\n")
    assert rows(read_name_list(spark, str(tmp_path / "names.csv"))) == [("h1",), ("h2",)]
    assert rows(read_sensor_names(spark, str(tmp_path / "sensors.txt"))) == [("A ",), ("B",)]
    assert read_indexed_csv(spark, str(tmp_path / "indexed.csv")).columns == ["A", "B"]
    assert file_key("A b c") == "A_b_c"


def test_fleet_sources(spark, tmp_path):
    make(spark, "users", [{"wguid": "a", "systemid": "h", "jobtitle": "T"}]).write.parquet(str(tmp_path / "users"))
    stored = Fleet(spark, root=str(tmp_path))
    assert rows(stored["users"]) == [("a", "h", "T")]
    with pytest.raises(KeyError):
        stored["nonsense"]
    publish_view(stored["users"], "known_users")
    assert rows(stored.sql("SELECT wguid FROM known_users")) == [("a",)]


def whole_fleet(spark):
    """Sensor S on machine a every day of a year, T on b in the last month, U never."""
    days = [day("2024-06-30") - timedelta(days=i) for i in range(1, 366)]
    results, raw = [], []
    for i, d in enumerate(days):
        n = 30 if i in (100, 101, 102) else 2 + i % 2
        for hour in range(n):
            when = at(f"{d} 00:00:00") + timedelta(minutes=10 * hour)
            results.append({"wguid": "a", "sensorname": "S", "sensorsystemid": "w", "resulttime": when})
    results.append({"wguid": "b", "sensorname": "T", "sensorsystemid": "w", "resulttime": at("2024-06-20 01:00:00")})
    for r in results:
        raw.append({"wguid": r["wguid"], "systemid": "w", "sensorname": r["sensorname"], "severity": 9,
                    "resulttime": r["resulttime"]})
    tables = {name: [] for name in TABLES}
    tables["sensor_results_daily"], tables["sensor_results_raw"] = results, raw
    tables["patches"] = [
        {"wguid": m, "patchname": "P", "installdate": at(f"{d} 05:00:00")}
        for m in "ab"
        for d in ("2024-03-15", "2024-06-15")
    ]
    return fleet(spark, **tables)


def test_daily_refresh_and_backfill(spark, root):
    tables = whole_fleet(spark)
    run = daily_refresh(tables, ["S", "U"], root, "2024-06-30")
    assert {*DATASETS, "results", "cohort", "timeline", "silent_sensors"} == set(os.listdir(f"{root}/runs/{run}"))
    assert set(os.listdir(root)) == {"runs", "manifest"}
    stored = read_report(spark, root)
    assert rows(stored["patches"]) == [("S", "P", 100.0)]
    assert rows(stored["silent_sensors"]) == [("U", True)]
    assert backfill(tables, ["S", "T", "U"], root, "2024-06-30") == ["T"]
    assert rows(read_report(spark, root, datasets=["cohort"])["cohort"]) == [("S", "a"), ("T", "b")]
    assert backfill(tables, ["S", "T", "U"], root, "2024-06-30") == []
    assert [held for _, _, held in runs_of(spark, root)] in (["S", "U"], [["S", "U"], ["T"]], [["T"], ["S", "U"]])
    daily_refresh(tables, ["T"], root, "2024-06-30")  # a whole run ends what others hold
    assert rows(read_report(spark, root, datasets=["cohort"])["cohort"]) == [("T", "b")]


STAGES = ["results", "timeline", "cohort", "patches", "health_members", "silent_sensors", "publish"]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("stage", STAGES)
def test_a_stopped_run_changes_nothing_and_is_made_good(spark, tmp_path, monkeypatch, stage):
    """A run of May is published, one of later in May stopped; readers see the first until a third completes all.

    The patch of S is from the first month only and T fires in the second only, so that rows of either would show.
    """
    tables = whole_fleet(spark)
    tables = Fleet(spark, frames={**{t: tables[t] for t in TABLES}, "patches": tables["patches"].where("installdate < '2024-05-01'")})
    wanted = [name for name in DATASETS if name in ("patches", "models", "health_members")]
    monkeypatch.setattr(refresh, "cohort_report", lambda *a: reports.cohort_report(*a[:5], [n for n in wanted if n in a[5]]))
    sensors, root, whole = ["S", "T", "U"], str(tmp_path / "stopped"), str(tmp_path / "whole")
    names = ("results", "timeline", "cohort", "silent_sensors", *wanted)
    daily_refresh(tables, sensors, root, "2024-04-10")
    before = {name: rows(df) for name, df in read_report(spark, root, datasets=names).items()}
    assert before["patches"] == [("S", "P", 100.0)] and before["silent_sensors"] == [("T", True), ("U", True)]
    write = refresh.write_dataset

    def stop(df, folder, name, **how):
        if name == stage:
            raise Stopped
        write(df, folder, name, **how)

    def no_publishing(*a, **how):
        raise Stopped

    with monkeypatch.context() as patched:
        patched.setattr(refresh, "write_dataset", stop)
        patched.setattr(refresh, "publish", no_publishing)
        with pytest.raises(Stopped):
            daily_refresh(tables, sensors, root, "2024-06-24")
    assert {name: rows(df) for name, df in read_report(spark, root, datasets=names).items()} == before
    assert backfill(tables, sensors, root, "2024-06-30") == sensors
    assert backfill(tables, sensors, root, "2024-06-30") == []
    daily_refresh(tables, sensors, whole, "2024-06-30")
    wanted, found = read_report(spark, whole, datasets=names), read_report(spark, root, datasets=names)
    for name, df in wanted.items():
        assert rows(found[name]) == rows(df), name
    assert rows(found["silent_sensors"]) == [("U", True)] and rows(found["patches"]) == []


def moving_fleet(spark, first=None, last=None):
    """Facts of every kind on many days, some at midnight; with bounds, only those in them, as if others were lost."""
    draw = random.Random(12)
    days = [day("2024-05-25") + timedelta(days=i) for i in range(45)]
    tables = {name: [] for name in TABLES}

    def add(table, time, **values):
        when = at(f"{draw.choice(days)} {draw.choice(['00:00:00', '00:00:01', '13:30:00', '23:59:59'])}")
        if (first is None or when >= at(first)) and (last is None or when <= at(last)):
            tables[table].append({time: when, **values})

    for _ in range(260):
        m = draw.choice("abcd")
        add("sensor_results_daily", "resulttime", wguid=m, sensorname=draw.choice("ST"), sensorsystemid="w")
        add("sensor_results_raw", "resulttime", wguid=m, systemid="w", sensorname=draw.choice("ST"), severity=9)
        add("patches", "installdate", wguid=m, patchname=draw.choice(["P", "Q", None, " "]))
        add("controllers", "datemodified", wguid=m, caption=draw.choice("xy"))
        add("software", "installdate", wguid=m, packagename=draw.choice("kl"), version=draw.choice(["1", None]))
        add("software_changes", "changetime", wguid=m, software=draw.choice(["o", None]), newversion=draw.choice("123"))
        add("app_faults", "vwtime", wguid=m, appname=draw.choice("vw"), appver=draw.choice(["1", "2", None]))
        add("app_usage", "starttime", wguid=m, applicationname=draw.choice("fgh"))
        add("health_daily", "vwtime", wguid=m, wscore=float(draw.randrange(60, 101)), activestatus=draw.randrange(2))
    tables["bios"] = [{"wguid": "a", "name": "B", "date": day("2020-01-01")}]
    return fleet(spark, **tables)


def same_report(spark, left, right):
    wanted = read_report(spark, right)
    for name, df in read_report(spark, left).items():
        assert rows(df) == rows(wanted[name]), name


def test_moving_the_window_reads_the_facts_of_the_new_days_only(spark, tmp_path):
    """Facts before the run of the day before, and after the day, are missing; the report is that of all facts."""
    sensors, moved = ["S", "T", "S:T", "U"], str(tmp_path / "moved")
    moving_refresh(moving_fleet(spark), sensors, moved, "2024-06-25")
    previous = "2024-06-25"
    for as_of, until in (("2024-06-26", "2024-06-27 00:00:00"), ("2024-06-29", "2024-06-30 00:00:00")):
        moving_refresh(moving_fleet(spark, f"{previous} 00:00:00", until), sensors, moved, as_of)
        whole = str(tmp_path / f"whole-{as_of}")
        daily_refresh(moving_fleet(spark), sensors, whole, as_of)
        same_report(spark, moved, whole)
        stored = read_report(spark, moved)
        assert all(rows(stored[name]) for name in ("patches", "software_changes", "app_faults", "app_usage", "health_members"))
        previous = as_of


def test_stored_report_scans_no_facts(spark, tmp_path):
    """The drill-down by model from stored windows equals that from the facts, whose tables are empty by then."""
    root = str(tmp_path / "moved")
    models = [{"wguid": m, "systemid": f"h{m}", "manufacturer": "M", "model": "X" if m in "abd" else "Y"} for m in "abcd"]
    owned = {"assets": [{"hostname": f"h{m}", "invoicedt": at("2021-05-05 00:00:00"), "assetlocation": "1"} for m in "abc"]}
    extra = {"system_config": make(spark, "system_config", models), "assets": make(spark, "assets", owned["assets"])}
    facts = moving_fleet(spark)
    whole = Fleet(spark, frames={**{t: facts[t] for t in TABLES}, **extra})
    moving_refresh(whole, ["S", "T"], root, "2024-06-25")
    moving_refresh(whole, ["S", "T"], root, "2024-06-26")
    empty = Fleet(spark, frames={t: whole[t] if t in (*extra, "bios") else make(spark, t, []) for t in TABLES})
    cohort = read_report(spark, root, datasets=["cohort"])["cohort"]
    for chosen in ({"model": "X"}, {"year": 2021}, {}):
        part = reports.drilldown if chosen else reports.cohort_report
        wanted = part(whole, cohort, "2024-05-27", "2024-06-26", "2024-06-26", **chosen)
        found = stored_report(empty, root, **chosen)
        assert set(found) == set(wanted) == set(DATASETS)
        for name in DATASETS:
            assert rows(found[name].select(wanted[name].columns)) == rows(wanted[name]), (name, chosen)
        assert rows(found["patches"]) and rows(found["models"])
    only = stored_report(empty, root, ["T"], model="X", folder=str(tmp_path / "parts"))
    assert {r.sensor for r in only["patches"].collect()} == {"T"}
    with pytest.raises(ValueError, match="0 runs"):
        stored_report(empty, root, ["U"])


def test_moving_starts_anew_for_other_sensors_and_after_a_long_pause(spark, tmp_path):
    moved, whole = str(tmp_path / "moved"), str(tmp_path / "whole")
    moving_refresh(moving_fleet(spark), ["S"], moved, "2024-05-26")
    moving_refresh(moving_fleet(spark), ["S", "T"], moved, "2024-05-27")
    moving_refresh(moving_fleet(spark), ["S", "T"], moved, "2024-07-01")
    daily_refresh(moving_fleet(spark), ["S", "T"], whole, "2024-07-01")
    same_report(spark, moved, whole)


def test_reading_a_stored_report_of_some_sensors(spark, root):
    shares = spark.createDataFrame([("007", "x", 60.0), ("A ", "y", 70.0)], "sensor string, patchname string, system_percentage double")
    run, folder = new_run(root, "2024-06-30")
    write_dataset(shares.select("patchname", "system_percentage", "sensor"), folder, "patches")
    assert read_report(spark, root, datasets=["patches"])["patches"].count() == 0
    publish(shares, root, run, "2024-06-30")
    stored = read_report(spark, root, ["007"], ["patches"])["patches"]
    assert rows(stored) == [("007", "x", 60.0)] and stored.columns == ["sensor", "patchname", "system_percentage"]
    assert rows(read_report(spark, root, ["A "], ["patches"])["patches"]) == [("A ", "y", 70.0)]


def test_anomaly_refresh(spark, root):
    root = f"{root}/runs/{anomaly_refresh(whole_fleet(spark), ['S', 'T', 'U'], root, '2024-06-30')}"
    points = spark.read.parquet(f"{root}/points")
    flagged = {r.ds for r in points.filter("is_anomaly").collect()}
    wide = read_csv(spark, f"{root}/anomaly_days", dates=["S"])
    assert wide.columns == ["position", "S"] and {r.S for r in wide.collect()} == flagged
    spike = day("2024-06-30") - timedelta(days=102)
    assert spike in flagged
    ranged = spark.read.parquet(f"{root}/cohort").collect()
    assert [(r.sensor, r.wguid) for r in ranged] == [("S", "a")]
    assert ranged[0].date_from == min(flagged) - timedelta(days=7) and ranged[0].date_to == max(flagged)
    results = spark.read.parquet(f"{root}/results")
    assert {r.resultdate for r in results.select("resultdate").distinct().collect()} == flagged


def test_settled_cohort_has_its_true_size(spark):
    machines = c.cohort(c.daily_results(whole_fleet(spark)))
    settled = settle(machines)
    assert "Scan parquet" in settled._jdf.queryExecution().executedPlan().toString() and rows(settled) == rows(machines)
    shared = spark.conf.get("spark.checkpoint.dir")
    assert any(name.startswith("settled-") for name in os.listdir(shared))


def test_last_week_export(spark):
    results = c.daily_results(whole_fleet(spark))
    exported = c.system_ids(c.last_week(results, "2024-06-30 09:00:00"))
    assert min(r.date for r in exported.collect()) == at("2024-06-23 00:00:00")
    assert rows(exported) == rows(c.system_ids(results, "2024-06-23"))


def test_catalogue_is_lazy_text(spark):
    assert catalogue_frame(spark, ["x"]).schema["sensor"].dataType.simpleString() == "string"
