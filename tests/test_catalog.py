"""Every registered query against its oracle, and the shape of its plan."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as driver
from cellgauge.catalog.oracle import ORACLE
from cellgauge.catalog.queries import REGISTRY

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
WRITERS = {
    "alert_log_before",
    "alert_log_changes",
    "alert_log_replay",
    "cell_csv_roundtrip",
    "cell_rejects",
    "lake_row_counts",
    "mart_row_counts",
    "province_geojson_bounds",
    "province_geojson_document",
    "subscriber_impact_refreshed",
    "telemetry_lake_roundtrip",
    "tower_metadata_from_csv",
}
# Joins that find few partners at the smallest size run at the next one too.
JOINS = (
    "subscriber_impact subscriber_impact_offset_hours event_history impact_totals neighbour_pairs neighbour_impact "
    "neighbour_alerts province_tags sessions_clean telemetry_clean quality_session_dates"
).split()
NEXT_SF = Path("/root/testdata/sf0.01")

needs_data = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def connect(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(ORACLE)
    assert set(REGISTRY) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, duck, folder, name):
    df = REGISTRY[name](spark, str(folder))
    found = duck.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == _sorted(found.fetchall(), names)


@needs_data
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_oracle(spark, duck, name):
    compare(spark, duck, SF, name)


@needs_data
@pytest.mark.parametrize("name", JOINS)
def test_join_equals_oracle_at_the_next_size(spark, name):
    compare(spark, connect(NEXT_SF), NEXT_SF, name)


@needs_data
@pytest.mark.parametrize("name", sorted(set(REGISTRY) - WRITERS))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = REGISTRY[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan, operator


@needs_data
def test_scan_reads_only_what_the_query_needs(spark):
    plan = REGISTRY["partition_volume"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    events = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "user_id" in s]
    assert events and all("props" not in s and "event_type" not in s and "value" not in s for s in events)


@needs_data
def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns[0] == "tower_id" and df.count() == 10
