"""Values worked out by hand for the small network of conftest."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cellgauge.network import MARTS, build_marts, create_views
from cellgauge.plans import marts, scoring, serving

from conftest import by_key, rows

T1, T2, T3 = "twr000000001", "twr000000002", "twr000000003"


def test_congestion_events(seed):
    got = rows(seed.congestion_events, "tower_id", "severity", "threshold_warn", "threshold_critical")
    assert got == [(T1, "WARN", 70.0, 85.0)] * 104


@pytest.mark.parametrize("unique", [True, False])
def test_hotspots(seed, unique):
    got = by_key(
        marts.hotspot_summary(seed.scored, seed.last_valid_day, unique),
        "tower_id",
        "congestion_frequency_7d",
        "congestion_frequency_30d",
        "avg_prb_utilization",
        "peak_congestion_hour",
        "total_affected_subscriber_hours",
    )
    assert got[T1] == pytest.approx((104 / 192 * 100, 104 / 192 * 100, 63.6666667, 8, 104))
    assert got[T2] == (0.0, 0.0, 42.0, None, 0)
    assert got[T3] == (0.0, 0.0, 42.0, None, 0)


def test_hotspot_windows_count_dates(seed, spark):
    """The 7-day window holds 8 dates."""
    at = marts.hotspot_summary(seed.scored, F.lit("2025-06-29").cast("date"))
    only = at.where(F.col("tower_id") == T1).first()
    assert only.congestion_frequency_7d == pytest.approx(13 / 24 * 100)
    later = marts.hotspot_summary(seed.scored, F.lit("2025-08-30").cast("date")).where(F.col("tower_id") == T1).first()
    assert (later.congestion_frequency_7d, later.congestion_frequency_30d) == (0.0, 0.0)
    assert later.total_affected_subscriber_hours == 104


def test_peak_hours(seed):
    got = {
        (r.tower_id, r.hour_of_day): (r.avg_prb_utilization, r.congestion_occurrence_rate, r.days_congested)
        for r in seed.peak_hour_patterns.collect()
    }
    assert len(got) == 24 + 23 + 24
    assert (T2, 12) not in got
    assert {h for (t, h), v in got.items() if v == (82.0, 100.0, 8)} == set(range(8, 21))
    assert all(v == (42.0, 0.0, 0) for (t, h), v in got.items() if t != T1)


def test_health(seed):
    got = by_key(seed.network_health_snapshot, "tower_id", "health_score", "connected_subscribers")
    assert got == {T1: (83.5, 60), T2: (93.2, 60), T3: (93.2, 60)}


def test_provinces(seed):
    got = by_key(
        seed.province_summary,
        "province_name",
        "tower_count",
        "congested_tower_count",
        "congestion_rate",
        "avg_health_score",
        "total_affected_subscriber_hours_7d",
        "island_group",
    )
    assert got == {
        "DKI Jakarta": (2, 1, 50.0, 88.4, 104, "Jawa"),
        "Jawa Barat": (1, 0, 0.0, 93.2, 0, "Jawa"),
    }


@pytest.mark.parametrize("options", [{}, {"masks_fit": False, "task_rows": 1}])
def test_subscriber_impact(seed, options):
    got = {
        r.event_hour: (r.subscriber_count_affected, r.degraded_session_minutes, r.voice_sessions, r.data_sessions, r.sms_sessions)
        for r in marts.subscriber_impact(seed.congestion_events, seed.sessions, **options).collect()
    }
    assert len(got) == 104
    assert got.pop(datetime(2025, 6, 28, 8)) == (1, 180.0, 1, 1, 0)
    assert got.pop(datetime(2025, 6, 28, 9)) == (1, 180.0, 1, 1, 0)
    assert got.pop(datetime(2025, 6, 28, 10)) == (1, 120.0, 0, 1, 0)
    assert set(got.values()) == {(0, None, 0, 0, 0)}


def test_neighbour_impact(seed, spark):
    assert rows(seed.neighbour_pairs) == [(T1, T2), (T2, T1)]
    assert seed.neighbour_impact.count() == 0
    more = seed.telemetry.withColumn(
        "handover_count", F.when(F.col("tower_id") == T2, F.hour("event_hour") + 20).otherwise(F.col("handover_count"))
    )
    # Above 30 from 11 h on; hour 12 is a fault at T2.
    got = rows(marts.neighbour_impact(seed.congestion_events, more, seed.neighbour_pairs))
    assert got == [(T1, T2, True)] * 9


def test_unknown_tower_and_type(seed, spark):
    """A reading without profile counts for hotspots but not for health, peaks or events."""
    stray = seed.telemetry.where(F.col("tower_id") == T1).withColumn("tower_id", F.lit("stray"))
    scored = scoring.score(stray, seed.profile)
    assert rows(marts.hotspot_summary(scored, seed.last_valid_day), "tower_id", "congestion_frequency_7d") == [("stray", 0.0)]
    assert marts.congestion_events(scored).count() == 0
    assert marts.network_health_snapshot(scored, seed.last_partition).count() == 0
    assert marts.peak_hour_patterns(scored, seed.last_partition).count() == 0


def test_build_marts_writes_tables(seed, spark, tmp_path):
    built = build_marts(seed, str(tmp_path / "marts"))
    assert set(built) == set(MARTS)
    counts = by_key(serving.row_counts(built), "table_name", "row_count")
    assert counts == {
        "congestion_events": 104,
        "hotspot_summary": 3,
        "peak_hour_patterns": 71,
        "neighbour_impact": 0,
        "subscriber_impact": 104,
        "network_health_snapshot": 3,
        "province_summary": 2,
    }
    for name in MARTS:
        assert rows(built[name], *sorted(built[name].columns)) == rows(getattr(seed, name), *sorted(built[name].columns))


def test_views(seed, spark):
    create_views(seed)
    assert spark.sql("SELECT count(*) FROM stg_tower_telemetry WHERE is_sensor_fault").first()[0] == 8
    assert spark.sql("SELECT count(*) FROM stg_subscriber_sessions").first()[0] == 3


def test_shuffled_profile_gives_the_same_scores(seed):
    salted = scoring.score(seed.telemetry, seed.profile, profile_fits=False)
    columns = ("tower_id", "event_hour", "severity", "health_score")
    assert rows(salted, *columns) == rows(seed.scored, *columns)


def test_neighbour_readings_are_shuffled_once(seed, spark, tmp_path):
    def stored(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        busy = seed.telemetry.withColumn("handover_count", F.when(F.col("tower_id") == T2, 99).otherwise(1))
        df = marts.neighbour_impact(
            stored("e", seed.congestion_events), stored("t", busy), stored("p", seed.neighbour_pairs)
        )
        assert df.collect() == [(T1, T2, True)]
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

