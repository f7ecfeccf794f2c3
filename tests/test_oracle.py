"""Every registered query against its SQL on the test tables."""

import math
import os
from datetime import date, datetime

import duckdb
import pytest

from fleetlens.testbed.oracle import oracle_sql
from fleetlens.testbed.queries import REGISTRY

SF_DIR = os.environ.get("FLEETLENS_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.3f}"
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(row[i]) for i in order) for row in rows], key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    df = REGISTRY[name](spark, SF_DIR)
    found = [tuple(row) for row in df.collect()]
    if name not in ORACLE:
        assert found and name.startswith("trend_anomalies")
        return
    cursor = duck.execute(ORACLE[name])
    names = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert expected, "the check would be empty"
    assert table(df.columns, found) == table(names, expected)
