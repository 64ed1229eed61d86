from datetime import date

from pyspark.sql import functions as F

from cellgauge.plans import quality, scoring
from cellgauge.plans.scoring import tower_profile

from conftest import by_key, rows

T1, T2, T3 = "twr000000001", "twr000000002", "twr000000003"


def test_clean_network_passes(seed, spark):
    subscribers = spark.createDataFrame([("sub000001",), ("sub000002",)], "subscriber_id STRING")
    report = quality.standard_checks(
        {
            "towers": seed.towers,
            "subscribers": subscribers,
            "telemetry": seed.telemetry,
            "sessions": seed.sessions,
            "events": seed.congestion_events,
            "hotspots": seed.hotspot_summary,
            "alerts": spark.createDataFrame([("ACTIVE",)], "status STRING"),
        }
    )
    assert report.count() == 17 and set(rows(report, "violations")) == {(0,)}
    assert quality.prb_out_of_range(seed.telemetry).count() == 0
    assert quality.missing_tower_hours(seed.telemetry, seed.towers).count() == 0
    assert quality.incomplete_telemetry_dates(seed.telemetry, seed.towers).count() == 0
    assert quality.events_without_threshold(seed.congestion_events, seed.profile).count() == 0


def test_nulls_and_duplicates(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 1)], "k STRING, v INT")
    assert rows(quality.nulls(df, ["k", "v"])) == [("k", 1), ("v", 2)]
    assert rows(quality.duplicates(df, ["k"])) == [("a", 2)]


def test_unexpected_values(seed):
    odd = seed.towers.withColumn("cell_type", F.when(F.col("tower_id") == T1, "lunar").otherwise(F.col("cell_type")))
    assert rows(quality.unexpected_values(odd, "cell_type", ["urban", "suburban", "rural"])) == [("lunar", 1)]


def test_prb_range(seed):
    unflagged = seed.telemetry.withColumn("is_sensor_fault", F.lit(False))
    assert rows(quality.prb_out_of_range(unflagged)) == [(8,)]


def test_threshold_defined(seed):
    partial = scoring.tower_profile(seed.towers, seed.thresholds.where("cell_type != 'urban'"))
    for fit in (True, False):
        assert quality.events_without_threshold(seed.congestion_events, partial, fit).count() == 104


def test_missing_hours(seed):
    holes = seed.telemetry.where(~((F.col("tower_id") == T2) & (F.hour("event_hour") < 3) & (F.col("partition_date") == F.lit(date(2025, 6, 24)))))
    holes = holes.where(~((F.col("tower_id") == T3) & (F.col("partition_date") == F.lit(date(2025, 6, 22)))))
    assert rows(quality.missing_tower_hours(holes, seed.towers)) == [(T2, date(2025, 6, 24), 3), (T3, date(2025, 6, 22), 24)]
    assert rows(quality.incomplete_telemetry_dates(holes, seed.towers)) == [
        (date(2025, 6, 22), 48, 72),
        (date(2025, 6, 24), 69, 72),
    ]


def test_dates_without_any_row_are_reported(seed, spark):
    gone = seed.telemetry.where(F.col("partition_date") != F.lit(date(2025, 6, 24)))
    assert rows(quality.incomplete_telemetry_dates(gone, seed.towers)) == [(date(2025, 6, 24), 0, 72)]
    asked = quality.incomplete_telemetry_dates(seed.telemetry, seed.towers, date(2025, 6, 27), date(2025, 6, 30))
    assert rows(asked) == [(date(2025, 6, 29), 0, 72), (date(2025, 6, 30), 0, 72)]
    one = spark.createDataFrame([("sub000001",)], "subscriber_id STRING")
    missing = quality.incomplete_session_dates(seed.sessions, one, first=date(2025, 6, 27), last=date(2025, 6, 28))
    assert rows(missing) == [(date(2025, 6, 27), 0, 3)]
    assert quality.incomplete_telemetry_dates(seed.telemetry.where("false"), seed.towers).count() == 0


def test_session_volume(seed, spark):
    one = spark.createDataFrame([("sub000001",)], "subscriber_id STRING")
    two = spark.createDataFrame([("sub000001",), ("sub000002",)], "subscriber_id STRING")
    assert quality.incomplete_session_dates(seed.sessions, one).count() == 0
    assert rows(quality.incomplete_session_dates(seed.sessions, two)) == [(date(2025, 6, 28), 3, 6)]


def test_tower_master(seed):
    assert quality.tower_master_problems(seed.towers, 3).count() == 0
    assert rows(quality.tower_master_problems(seed.towers, 4)) == [(3, 0, 4)]
    broken = seed.towers.withColumn("lat", F.when(F.col("tower_id") != T1, F.col("lat")))
    assert rows(quality.tower_master_problems(broken, 3)) == [(3, 1, 3)]


def test_orphans(seed, spark):
    child = spark.createDataFrame([(T1,), ("x",), ("x",), (None,)], "tower_id STRING")
    assert by_key(quality.orphans(child, seed.towers, "tower_id", F.col("tower_id")), "tower_id", "violations") == {"x": 2}


def test_standard_checks_scan_each_table_once(spark, seed, tmp_path):
    tables = {
        "towers": seed.towers,
        "subscribers": seed.sessions.select("subscriber_id").distinct(),
        "telemetry": seed.telemetry,
        "sessions": seed.sessions,
        "events": seed.congestion_events,
        "hotspots": seed.hotspot_summary,
        "alerts": spark.createDataFrame([("ACTIVE",), ("LOST",), ("LOST",), (None,)], "status string"),
        "thresholds": seed.thresholds,
    }
    stored = {}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    found = quality.standard_checks(stored)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Towers are also looked up, for all checks at once, and their types' thresholds with them.
    scans = [line for line in plan.splitlines() if "Relation [" in line]
    assert len(scans) == len(tables) + 1
    got = {r.check_name: r.violations for r in found.collect()}
    assert len(got) == 18 and {n: v for n, v in got.items() if v} == {"alerts status accepted": 1}


def test_standard_checks_count_as_single_checks_do(spark, seed):
    T = seed.towers
    odd = T.withColumn("cell_type", F.lit("moon")).unionByName(T.limit(1)).unionByName(T.limit(1).withColumn("cell_type", F.lit(None)))
    lost = seed.telemetry.unionByName(seed.telemetry.limit(5)).unionByName(seed.telemetry.limit(2).withColumn("tower_id", F.lit(None)))
    events = seed.congestion_events.withColumn("tower_id", F.when(F.hour("event_hour") == 9, "gone").when(F.hour("event_hour") != 10, F.col("tower_id")))
    sessions = seed.sessions.withColumn("tower_id", F.lit("far")).withColumn("service_type", F.lit("fax"))
    tables = {
        "towers": odd,
        "subscribers": seed.sessions.select("subscriber_id"),
        "telemetry": lost.withColumn("prb_utilization", F.lit(-1.0)),
        "sessions": sessions,
        "events": events,
        "hotspots": seed.hotspot_summary,
        "alerts": spark.createDataFrame([], "status string"),
        "thresholds": seed.thresholds,
    }
    got = {r.check_name: r.violations for r in quality.standard_checks(tables).collect()}
    profile = tower_profile(odd, seed.thresholds)
    want = {
        "telemetry tower_id/event_hour not null": lost.where("tower_id IS NULL").count(),
        "telemetry tower_id/event_hour unique": quality.duplicates(lost, ["tower_id", "event_hour"]).count(),
        "telemetry prb range": 1,
        "towers tower_id/cell_type not null": 1,
        "towers tower_id unique": quality.duplicates(odd, ["tower_id"]).count(),
        "towers cell_type accepted": 1,
        "subscribers subscriber_id unique": 1,
        "sessions service_type accepted": 1,
        "sessions tower known": 1,
        "events tower_id/severity not null": events.where("tower_id IS NULL").count(),
        "events tower known": quality.orphans(events, odd, "tower_id", F.col("tower_id")).count(),
        "events threshold defined": quality.events_without_threshold(events, profile).count(),
    }
    assert {n: v for n, v in got.items() if v} == {n: v for n, v in want.items() if v}
