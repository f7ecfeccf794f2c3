import math
from datetime import timedelta

import numpy as np
import pytest

from fleetlens.operators import anomaly, enriched, timeseries
from fleetlens.operators.forest import anomaly_scores, is_anomaly
from frames import at, day, fleet, rows

START = day("2024-01-01")


def series(spark, values, sensor="S", skip=()):
    days = [START + timedelta(days=i) for i in range(len(values) + len(skip)) if i not in skip]
    return spark.createDataFrame([(sensor, d, int(v)) for d, v in zip(days, values)], "sensor string, ds date, y long")


def test_trend_needs_a_full_window_of_rows(spark):
    found = timeseries.trend(series(spark, range(14), skip=(3,))).orderBy("ds").collect()
    assert [r.trend for r in found] == [None] * 3 + [float(i) for i in range(3, 11)] + [None] * 3


def test_short_series_drop_out(spark):
    both = series(spark, range(14), "long", skip=(5,)).unionByName(series(spark, range(13), "short"))
    assert {r.sensor for r in timeseries.long_enough(both).collect()} == {"long"}


def test_decomposition_adds_up(spark):
    values = [10 + i // 3 + (5 if i % 7 == 0 else 0) for i in range(35)]
    found = timeseries.decompose(series(spark, values)).orderBy("ds").collect()
    for r in found:
        if r.trend is not None:
            assert r.trend + r.seasonal + r.residual == pytest.approx(r.y)
    assert sum(r.seasonal for r in found[:7]) == pytest.approx(0, abs=1e-9)
    assert [r.seasonal for r in found[:7]] == pytest.approx([r.seasonal for r in found[7:14]])
    assert found[0].seasonal == max(r.seasonal for r in found)


def test_filled_gaps_and_slice(spark):
    gap = series(spark, [1, 2], skip=(1,))
    results = gap.selectExpr("sensor", "CAST(ds AS TIMESTAMP) AS resulttime", "explode(sequence(1, y)) AS i")
    filled = timeseries.daily_series(results, fill_gaps=True)
    assert [r.y for r in filled.orderBy("ds").collect()] == [1, 0, 2]
    assert rows(timeseries.series_slice(gap, "2024-01-02", "2024-01-03").select("y")) == [(2,)]


def test_band_and_rolling(spark):
    band = timeseries.sigma_band(series(spark, [0, 10])).first()
    assert (band.mean, band.lower) == (5.0, 0.0)
    assert band.upper == pytest.approx(5 + 3 * math.sqrt(50))
    found = timeseries.rolling_stats(series(spark, range(8)), (7,)).orderBy("ds").collect()
    assert [r.mean_7 for r in found] == [None] * 6 + [3.0, 4.0]


def test_forest_scores():
    values = np.concatenate([np.linspace(10, 20, 300), [200.0]])
    scores = anomaly_scores(values, "one")
    assert scores.argmax() == 300 and scores[300] > 0.7 and ((scores > 0) & (scores < 1)).all()
    assert (anomaly_scores(np.full(20, 5.0), "a") == anomaly_scores(np.full(20, 5.0), "b")).all()
    assert not is_anomaly(np.full(20, 5.0), "constant").any()
    assert len(is_anomaly(np.zeros(0), "empty")) == 0


def slow_mean_depth(values, size, limit, trees, rng):
    """The forest as in the paper, one point and one node at a time."""

    def c(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def grow(sample, depth):
        if depth == limit or min(sample) == max(sample):
            return len(sample)
        split = rng.uniform(min(sample), max(sample))
        left, right = [v for v in sample if v <= split], [v for v in sample if v > split]
        return split, grow(left, depth + 1), grow(right, depth + 1)

    def path(node, value):
        if isinstance(node, int):
            return c(node)
        return 1 + path(node[1] if value <= node[0] else node[2], value)

    total = np.zeros(len(values))
    for _ in range(trees):
        tree = grow(list(rng.choice(values, size, replace=False)), 0)
        total += [path(tree, v) for v in values]
    return total / trees


def test_forest_agrees_with_the_plain_definition():
    rng = np.random.default_rng(3)
    values = np.sort(rng.normal(50, 10, 40))
    expected = slow_mean_depth(values, 40, 6, 1500, rng)
    scores = anomaly_scores(values, "five", trees=1500)
    c = 2 * (math.log(39) + np.euler_gamma) - 2 * 39 / 40
    assert -np.log2(scores) * c == pytest.approx(expected, abs=0.35)


def test_planted_spike_and_stable_labels(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(95, 105, 120)
    values[60] = 2000
    parts = series(spark, values, "spike").unionByName(series(spark, rng.integers(1, 9, 60), "calm"))
    first = rows(anomaly.trend_anomalies(parts.repartition(1)))
    assert first == rows(anomaly.trend_anomalies(parts.repartition(7, "ds")))
    flagged = {r[1] for r in first if r[0] == "spike" and r[4]}
    assert {START + timedelta(days=d) for d in range(57, 64)} <= flagged
    for sensor, length in (("spike", 114), ("calm", 54)):
        n = sum(r[4] for r in first if r[0] == sensor)
        assert 0 < n <= math.ceil(length / 10)
    assert all(not r[4] for r in first if r[3] is None)


def test_days_bounds_and_wide(spark):
    points = spark.createDataFrame(
        [("A", day("2024-01-10"), 1.0, True), ("A", day("2024-01-05"), 1.0, True), ("A", day("2024-01-07"), 1.0, False),
         ("B", day("2024-01-09"), 1.0, True), ("C", day("2024-01-09"), 1.0, False)],
        "sensor string, ds date, trend double, is_anomaly boolean",
    )
    days = anomaly.anomaly_days(points)
    assert rows(anomaly.anomaly_bounds(days)) == [
        ("A", day("2024-01-05"), day("2024-01-10")),
        ("B", day("2024-01-09"), day("2024-01-09")),
    ]
    wide = anomaly.anomaly_days_wide(days)
    assert wide.columns == ["position", "A", "B"]  # no column without any day
    assert rows(wide) == [(1, day("2024-01-05"), day("2024-01-09")), (2, day("2024-01-10"), None)]
    machines = spark.createDataFrame([("A", "m"), ("C", "m")], "sensor string, wguid string")
    assert rows(anomaly.ranged_cohort(machines, days)) == [("A", "m", day("2023-12-29"), day("2024-01-10"))]


def test_snapshot(spark):
    def point(sensor, date, value):
        return (sensor, day(date), value, True)

    points = spark.createDataFrame(
        [
            point("risen", "2024-01-25", 5.0),
            point("old", "2023-12-01", 9.0),
            point("fallen", "2024-01-20", 5.0),
            point("grown", "2024-01-23", 5.5),  # the first day of the last week
            point("grown", "2024-01-22", 4.0),
            point("grown", "2024-01-16", 1.0),  # the first day of the week before
            point("grown", "2024-01-15", 99.0),
            point("future", "2024-02-10", 2.5),  # the last week is open
            ("grown", day("2024-01-24"), 1000.0, False),
        ],
        "sensor string, ds date, trend double, is_anomaly boolean",
    )
    found = anomaly.anomaly_snapshot(points, "2024-01-30").orderBy("rank").collect()
    assert [tuple(r) for r in found] == [
        ("future", 2, 100, 1),
        ("risen", 5, 100, 2),
        ("grown", 6, 10, 3),
        ("fallen", 0, -100, 4),
        ("old", 0, None, 5),
    ]


def test_duplicate_dimension_rows_repeat_results(spark):
    def result(time, severity=5, systemid="w"):
        return {"wguid": "a", "systemid": systemid, "sensorsystemid": systemid, "sensorid": "r", "sensorname": "S",
                "severity": severity, "resulttime": at(time)}

    tables = fleet(
        spark,
        sensor_results_raw=[
            result("2024-01-01"),
            result("2024-01-02"),
            result("2024-01-02", 4),
            result("2024-01-02", 5, "V2"),
        ],
        derived_sensors=[result("2024-01-02"), result("2024-01-03")],
        system_config=[{"wguid": "a", "systemid": "h", "totalphysicalmemory": 25_000_000, "model": m} for m in "xy"],
        sensor_information=[{"ruleid": "r", "sensorcategory": "c", "description": "d"}],
    )
    wide = enriched.sensor_enriched(tables, "2024-01-01", "2024-01-03")  # both bounds are excluded
    assert wide.count() == 4 and wide.first().memory_1e7 == 2.5
    assert enriched.sensor_enriched(tables, "2024-01-01", "2024-01-03", dedupe_dimensions=True).count() == 2
    assert rows(enriched.enriched_daily_series(tables, "2024-01-01", "2024-01-03")) == [("S", day("2024-01-02"), 4)]
    once = enriched.enriched_daily_series(tables, "2024-01-01", "2024-01-03", ["S"], dedupe_dimensions=True)
    assert rows(once) == [("S", day("2024-01-02"), 2)]
