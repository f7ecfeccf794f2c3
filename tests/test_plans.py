"""What the executed plans look like."""

import os
import re
import subprocess
import sys

import pytest

from fleetlens.testbed.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(autouse=True)
def whole_strings(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture(params=["10MB", "-1"])
def limit(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_presence_scans_the_facts_once(spark, limit):
    plan = final_plan(REGISTRY["patch_presence"](spark, SF_DIR))
    assert len(re.findall(r"Location:[^]]*lineitem\.parquet", plan)) == 1
    assert "ReusedExchange" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if limit == "-1":
        assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["compare_machines", "patch_presence", "anomaly_report_patches"])
def test_lines_are_not_sorted_for_their_orders(spark, limit, name):
    plan = REGISTRY[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_orderkey" in plan
    assert not re.search(r"Sort \[l_orderkey", plan)


def _below(plan: str, node: str) -> list[str]:
    """What is below each such node of a plan, as text."""
    lines, found = plan.splitlines(), []
    depth = [re.search(r"[A-Za-z]", line).start() if re.search(r"[A-Za-z]", line) else 0 for line in lines]
    for i, line in enumerate(lines):
        if node in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i + 1 : end]))
    return found


@pytest.mark.parametrize("name", ["anomaly_report_patches", "anomaly_report_patch_machines", "patch_presence"])
def test_rows_are_doubled_after_the_join_with_the_cohort(spark, name):
    """Facts are shuffled and hashed once, not a second time for the number of machines."""
    plan = REGISTRY[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    parts = _below(plan, "Generate explode([false,true])")
    assert parts and all(re.search(r"Join Inner, \(wguid#\d+L? = wguid#\d+L?\)", part) for part in parts)


def test_drilldown_restricts_the_facts(spark):
    plan = REGISTRY["drilldown_model"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "nation.parquet" not in plan


def test_the_report_restricts_the_orders_before_the_lines(spark):
    """Lines of machines outside the cohort are neither counted nor shuffled again."""
    plan = REGISTRY["whole_report"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    joins = _below(plan, "Join Inner, (l_orderkey")
    assert joins and all("Join LeftSemi, (o_custkey" in part for part in joins)


@pytest.mark.parametrize("dataset", ["patches", "patch_machines", "changes", "usage"])
def test_anomaly_reports_restrict_the_orders_before_the_lines(spark, dataset):
    """Lines of machines without an abnormal day are neither hashed nor shuffled again."""
    plan = REGISTRY[f"anomaly_report_{dataset}"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    joins = _below(plan, "Join Inner, (l_orderkey")
    assert joins and all("Join LeftSemi, (o_custkey" in part for part in joins)


@pytest.mark.parametrize("name", ["anomaly_report_patches", "drilldown_ranged"])
def test_ranged_reports_bound_the_scan(spark, name):
    plan = REGISTRY[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert scans and all("GreaterThanOrEqual(l_shipdate" in line for line in scans)


def test_filters_and_columns_reach_the_scan(spark):
    plan = REGISTRY["patch_presence"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThanOrEqual(l_shipdate" in scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_shipdate:timestamp_ntz>" in scan


def test_no_python_outside_the_forest(spark):
    for name, build in REGISTRY.items():
        plan = build(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert ("InPandas" in plan) == name.startswith("trend_anomalies"), name
        assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|Join Cross", plan), name


@pytest.mark.parametrize("name", ["software_change_presence", "app_fault_presence"])
def test_newest_rows_are_cut_before_the_shuffle(spark, name):
    plan = REGISTRY[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.index("WindowGroupLimit"), plan.rindex("Partial", 0, plan.rindex("WindowGroupLimit") + 400)
    assert final < plan.index("Exchange hashpartitioning", final) < partial


def test_job_titles_are_cut_before_the_shuffle(spark):
    plan = REGISTRY["title_top20"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


@pytest.mark.parametrize("missing", [("fleetlens.llm", "corpus_pipeline"), ("public_tokenizers",), ("regex",)])
def test_the_entry_works_without_the_optional_subpackage(missing):
    """The other queries stay registered when the subpackage or something that only it needs is gone."""
    code = (
        f"import sys; sys.modules.update(dict.fromkeys({missing!r}))\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries()); print(len(names), 'presence_all_sensors' in names, 'pipeline' in names)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[1:] == ["True", "False"], said.stderr
