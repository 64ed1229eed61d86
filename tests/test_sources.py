import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from cellgauge.schemas import TELEMETRY_SCHEMA, THRESHOLD_ROWS
from cellgauge.sources import cells, lake

from conftest import rows


def test_partition_replace_is_idempotent(spark, seed, tmp_path):
    path = str(tmp_path / "telemetry")
    lake.write_dates(seed.telemetry, path)
    day = date(2025, 6, 25)
    again = seed.telemetry.where(F.col("partition_date") == F.lit(day)).withColumn("prb_utilization", F.lit(1.0))
    for _ in range(2):
        lake.write_dates(again, path)
        stored = lake.read_dates(spark, path, TELEMETRY_SCHEMA)
        assert stored.columns == TELEMETRY_SCHEMA.names
        assert stored.count() == 576
        assert stored.where(F.col("prb_utilization") == 1.0).select("partition_date").distinct().collect() == [(day,)]
    assert lake.row_count(spark, path, TELEMETRY_SCHEMA, day) == 72
    assert lake.read_dates(spark, path, TELEMETRY_SCHEMA, date(2025, 6, 27), date(2025, 6, 28)).count() == 144


def test_one_date_reads_one_directory(spark, seed, tmp_path):
    path = str(tmp_path / "telemetry")
    lake.write_dates(seed.telemetry, path)
    day = date(2025, 6, 25)
    plan = lake.read_dates(spark, path, TELEMETRY_SCHEMA, day, day).select("tower_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(partition_date" in plan
    assert "ReadSchema: struct<tower_id:string>" in plan


def test_dated_tree(spark, seed, tmp_path):
    root = str(tmp_path)
    days = [date(2025, 6, 21), date(2025, 6, 22)]
    for day in days:
        one = seed.telemetry.where(F.col("partition_date") == F.lit(day)).drop("partition_date")
        one.coalesce(1).write.parquet(lake.dated_path(root, "raw", "tower_telemetry", day))
    assert lake.dated_path("x", "raw", "cells", date(2025, 1, 5)) == "x/raw/cells/2025/01/05/data.parquet"
    some = lake.read_dated_tree(spark, root, "raw", "tower_telemetry", days[:1], TELEMETRY_SCHEMA)
    assert some.columns == TELEMETRY_SCHEMA.names and some.count() == 72
    with pytest.raises(ValueError):
        lake.dated_path("x", "attic", "y", days[0])


def test_dated_tree_takes_the_date_from_the_path(spark, seed, tmp_path):
    import pyarrow.parquet as pq

    day = date(2025, 6, 21)
    target = tmp_path / "staging" / "t" / "2025" / "06" / "21"
    target.mkdir(parents=True)
    one = seed.telemetry.where(F.col("partition_date") == F.lit(day)).drop("partition_date")
    pq.write_table(one.toArrow(), target / "data.parquet")
    for days in (None, [day]):
        got = lake.read_dated_tree(spark, str(tmp_path), "staging", "t", days, TELEMETRY_SCHEMA)
        assert got.count() == 72
        assert got.select("partition_date").distinct().collect() == [(day,)]


def test_snapshots_never_overwrite(spark, tmp_path):
    root = str(tmp_path / "alerts")
    first = lake.new_snapshot(spark.range(3), root)
    second = lake.new_snapshot(spark.read.parquet(first).where("id > 0"), root)
    assert first != second
    assert spark.read.parquet(first).count() == 3 and spark.read.parquet(second).count() == 2


def test_threshold_file(spark, tmp_path):
    path = tmp_path / "thresholds.csv"
    path.write_text(
        "cell_type,prb_warn_pct,prb_critical_pct,latency_warn_ms,dropped_call_warn_pct\n"
        "urban,70,85,50,2.0\nsuburban,65,80,60,2.5\nrural,60,75,80,3.0\n"
    )
    assert rows(cells.read_thresholds(spark, str(path))) == sorted(THRESHOLD_ROWS, key=repr)


def test_shared_folder_is_the_clusters(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert lake.shared_dir(spark) == folder
    assert lake.scratch_path(spark, "x").startswith(folder)
    assert lake.scratch_path(spark, "x", "/elsewhere").startswith("/elsewhere/")


class _Conf(dict):
    get = dict.get


def test_only_a_local_master_may_do_without_shared_folder():
    from types import SimpleNamespace

    local = SimpleNamespace(conf=_Conf({"spark.master": "local[4]"}))
    assert lake.shared_dir(local) == lake.shared_dir(local) and "spark.checkpoint.dir" not in local.conf
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            lake.shared_dir(SimpleNamespace(conf=_Conf({"spark.master": master})))


def test_dates_come_from_the_listing(seed, spark, tmp_path):
    lake.write_dates(seed.telemetry, str(tmp_path / "t"))
    table = lake.read_dates(spark, str(tmp_path / "t"), TELEMETRY_SCHEMA)
    assert lake.partition_dates(table) == [date(2025, 6, d) for d in range(21, 29)]
    assert lake.partition_dates(seed.telemetry) == []


def _partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("PartitionFilters: [")[1:]]


def test_windows_read_only_their_dates(seed, spark, tmp_path):
    """Static bounds in the scans of windowed reports and marts over a date-partitioned table."""
    from dataclasses import replace

    from cellgauge.plans import serving

    lake.write_dates(seed.telemetry, str(tmp_path / "t"))
    n = replace(seed, telemetry=lake.read_dates(spark, str(tmp_path / "t"), TELEMETRY_SCHEMA), dates=None)
    assert n.dates == (date(2025, 6, 21), date(2025, 6, 28))
    day = serving.tower_map(n.towers, n.scored, n.newest_hour, "24h")
    assert day.collect() and all("partition_date" in f and "2025-06-27" in f.split("]")[0] for f in _partition_filters(day))
    peaks = n.peak_hour_patterns
    assert "2025-05-29" in _partition_filters(peaks)[0].split("]")[0]
    assert rows(peaks) == rows(seed.peak_hour_patterns) and rows(n.hotspot_summary) == rows(seed.hotspot_summary)
    series = serving.prb_series(n.telemetry, newest_fits=True)
    assert any("partition_date" in f.split("]")[0] and ">=" in f.split("]")[0] for f in _partition_filters(series))
    assert rows(series) == rows(serving.prb_series(seed.telemetry))


def test_refreshing_dates_equals_a_full_build(seed, spark, tmp_path):
    from dataclasses import replace

    from cellgauge.network import build_marts, refresh_dates

    first, last = date(2025, 6, 26), date(2025, 6, 28)
    lake.write_dates(seed.telemetry, str(tmp_path / "t"))
    whole = replace(seed, telemetry=lake.read_dates(spark, str(tmp_path / "t"), TELEMETRY_SCHEMA), dates=None)
    early = replace(whole, telemetry=whole.telemetry.where(F.col("partition_date") < F.lit(first)), dates=None)
    full = build_marts(whole, str(tmp_path / "full"))
    build_marts(early, str(tmp_path / "part"))
    for _ in range(2):  # again changes nothing
        refresh_dates(whole, str(tmp_path / "part"), first, last)
        for name in ("congestion_events", "subscriber_impact"):
            got = spark.read.parquet(str(tmp_path / "part" / name)).select(*full[name].columns)
            assert rows(got) == rows(full[name])
    calm = replace(whole, telemetry=whole.telemetry.withColumn("prb_utilization", F.lit(1.0)), dates=whole.dates)
    refresh_dates(calm, str(tmp_path / "part"), last, last)
    left = spark.read.parquet(str(tmp_path / "part" / "congestion_events"))
    assert left.where(F.col("partition_date") == F.lit(last)).count() == 0 and left.count() > 0


def test_geojson_with_a_feature_to_a_line(spark, tmp_path):
    square = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]
    provinces = spark.createDataFrame([(n, square) for n in ["A", "B", "C, {", None, "B"]], "province_name string, polygons array<array<array<array<double>>>>").repartition(3)
    path = str(tmp_path / "lines")
    cells.write_feature_lines(provinces, path)
    files = sorted((tmp_path / "lines").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert len(json.loads(text)["features"]) == 5
    assert rows(cells.read_feature_lines(spark, path)) == rows(provinces)
    (tmp_path / "one.json").write_text(text)
    assert rows(cells.read_provinces(spark, str(tmp_path / "one.json"))) == rows(provinces)
    cells.write_feature_lines(provinces.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none").glob("part-*")))) == {"type": "FeatureCollection", "features": []}
    assert cells.read_feature_lines(spark, str(tmp_path / "none")).isEmpty()


def test_dated_tree_is_written_in_one_job_and_replaced_by_date(spark, seed, tmp_path):
    root = str(tmp_path)
    t = seed.telemetry
    lake.write_dated_tree(t, root, "raw", "telemetry")
    assert (tmp_path / "raw/telemetry/2025/06/21").is_dir() and not list((tmp_path / "raw").glob("_*"))
    half = t.where((F.col("partition_date") == date(2025, 6, 21)) & (F.hour("event_hour") < 12))
    lake.write_dated_tree(half, root, "raw", "telemetry")
    got = lake.read_dated_tree(spark, root, "raw", "telemetry", None, TELEMETRY_SCHEMA).select(*t.columns)
    want = t.where((F.col("partition_date") != date(2025, 6, 21)) | (F.hour("event_hour") < 12))
    assert rows(got) == rows(want)
    lake.write_dates(t, str(tmp_path / "t"))
    assert rows(lake.row_counts(spark, str(tmp_path / "t"), TELEMETRY_SCHEMA)) == rows(t.groupBy("partition_date").count())
