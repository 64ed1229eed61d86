from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cellgauge.plans import serving
from cellgauge.schemas import ALERT_SCHEMA, TOWER_SCHEMA

from conftest import by_key, rows, tower

T1, T2, T3 = "twr000000001", "twr000000002", "twr000000003"
NOW = datetime(2025, 6, 29)


def tower_map(seed, window):
    return serving.tower_map(seed.towers, seed.scored, serving.newest_hour(seed.telemetry), window)


@pytest.mark.parametrize(
    "window, expected",
    [
        ("24h", {T1: (83.8, 62.8), T2: (93.2, 42.0), T3: (93.2, 42.0)}),
        ("7d", {T1: (83.5, 63.5), T2: (93.2, 42.0), T3: (93.2, 42.0)}),
        ("30d", {T1: (83.5, 63.7), T2: (93.2, 42.0), T3: (93.2, 42.0)}),
    ],
)
def test_tower_map(seed, window, expected):
    assert by_key(tower_map(seed, window), "tower_id", "health_score", "avg_prb_utilization") == expected


def test_silent_tower_stays_on_the_map(seed, spark):
    silent = spark.createDataFrame([tower("silent", 0.0, 0.0, province=None, island=None)], TOWER_SCHEMA)
    every = serving.tower_map(
        seed.towers.unionByName(silent), seed.scored, serving.newest_hour(seed.telemetry), "7d"
    )
    assert by_key(every, "tower_id", "health_score", "connected_subscribers")["silent"] == (None, None)
    got = by_key(
        serving.province_map(every), "province_name", "tower_count", "congested_tower_count", "total_connected_subscribers", "avg_health_score"
    )
    assert got == {"DKI Jakarta": (2, 0, 120, 88.4), "Jawa Barat": (1, 0, 60, 93.2), None: (1, 0, 0, None)}
    assert rows(serving.map_scope(every, tower_id="silent"), "tower_id") == [("silent",)]
    assert rows(serving.map_scope(every, tower_id=T2), "tower_id") == [(T1,), (T2,)]
    assert rows(serving.map_scope(every, province="Jawa Barat"), "tower_id") == [(T3,)]
    assert serving.map_scope(every).count() == 0


def test_leaderboards(seed):
    board = serving.hotspot_leaderboard(seed.hotspot_summary, seed.towers).collect()
    assert [(r["rank"], r.tower_id, r.congestion_frequency_pct) for r in board] == [(1, T1, 54.2), (2, T2, 0.0), (3, T3, 0.0)]
    assert serving.hotspot_leaderboard(seed.hotspot_summary, seed.towers, "30d", top=1).count() == 1
    provinces = serving.province_leaderboard(seed.towers, seed.hotspot_summary, seed.network_health_snapshot)
    view = serving.province_leaderboard_view(provinces).collect()
    assert [(r["rank"], r.province_name, r.avg_congestion_frequency_pct, r.congested_towers, r.affected_subscriber_hours) for r in view] == [
        (1, "DKI Jakarta", 27.1, 1, 104)
    ]


def test_provinces_are_ranked_by_the_mean_before_rounding(seed, spark):
    towers = seed.towers.withColumn(
        "province_name", F.when(F.col("tower_id") == T1, "A").when(F.col("tower_id") == T2, "B").otherwise("C")
    )
    hotspots = seed.hotspot_summary.withColumn(
        "congestion_frequency_7d",
        F.when(F.col("tower_id") == T1, 12.31).when(F.col("tower_id") == T2, 12.34).otherwise(12.34),
    )
    board = serving.province_leaderboard(towers, hotspots, seed.network_health_snapshot).collect()
    assert [(r.province_name, r.avg_congestion_frequency) for r in board] == [("B", 12.3), ("C", 12.3), ("A", 12.3)]


def test_province_towers(seed):
    got = serving.province_towers(tower_map(seed, "7d"), seed.hotspot_summary, "DKI Jakarta").collect()
    assert [(r.tower_id, r.health_score) for r in got] == [(T1, 83.5), (T2, 93.2)]
    view = serving.province_towers_view(serving.province_towers(tower_map(seed, "7d"), seed.hotspot_summary))
    assert by_key(view, "tower_id", "congestion_frequency_pct", "subscribers")[T1] == (54.2, 60)


def test_latest_reading_skips_faults(seed):
    shifted = seed.telemetry.withColumn("is_sensor_fault", F.hour("event_hour") > 12)
    got = by_key(serving.latest_reading(shifted), "tower_id", "event_hour", "prb_utilization")
    assert got[T2] == (datetime(2025, 6, 28, 12), 115.0)
    assert set(by_key(serving.latest_reading(shifted, T1), "tower_id", "event_hour")) == {T1}


def test_prb_series_is_anchored_to_the_tower(seed):
    early = seed.telemetry.where((F.col("tower_id") != T3) | (F.col("partition_date") < F.lit(date(2025, 6, 24))))
    assert by_key(serving.prb_series(early, days=1).groupBy("tower_id").count(), "tower_id", "count") == {T1: 25, T2: 24, T3: 25}
    series = serving.prb_series(early, T3, days=1).collect()
    assert series[0].event_hour == datetime(2025, 6, 22, 23) and len(series) == 25


def test_event_history(seed):
    rows_ = serving.event_history(seed.congestion_events, seed.subscriber_impact, T1).collect()
    assert len(rows_) == 104
    assert rows_[0].event_hour == datetime(2025, 6, 28, 20) and rows_[0].degraded_session_minutes == 0
    view = serving.event_history_view(serving.event_history(seed.congestion_events, seed.subscriber_impact))
    busy = view.where((F.col("event_date") == F.lit(date(2025, 6, 28))) & (F.col("hour") == 9)).first()
    assert (busy.subscribers_affected, busy.degraded_minutes) == (1, 180.0)


def test_weekday_grid(seed):
    cells = serving.prb_by_weekday_hour(seed.telemetry.where(F.col("partition_date") < F.lit(date(2025, 6, 23))))
    grid = serving.weekday_hour_grid(cells)
    assert grid.count() == 21 and len(grid.columns) == 26
    got = {(r.tower_id, r.day_of_week): r for r in grid.collect()}
    assert (got[T1, 6].h07, got[T1, 6].h08) == (42.0, 82.0)
    assert got[T2, 0].h12 is None and got[T2, 0].h13 == 42.0
    assert got[T1, 3].h08 is None


def test_peak_profile_and_metadata(seed):
    profile = serving.peak_hour_profile(seed.peak_hour_patterns, T1).collect()
    assert [r.hour_of_day for r in profile] == list(range(24))
    got = by_key(serving.tower_metadata(seed.towers, seed.thresholds), "tower_id", "prb_warn_pct", "prb_critical_pct", "latency_warn_ms")
    assert got == {T1: (70.0, 85.0, 50.0), T2: (65.0, 80.0, 60.0), T3: (60.0, 75.0, 80.0)}


def test_neighbour_list(seed, spark):
    spill = spark.createDataFrame([(T1, T2, True), (T3, T1, True)], "source_tower_id STRING, neighbour_tower_id STRING, is_spillover BOOLEAN")
    got = serving.neighbour_list_view(serving.neighbour_list(spill, seed.towers, T1))
    assert rows(got) == [(T1, T2, "DKI Jakarta", "suburban", True)]


def test_impact_totals(seed):
    one = serving.impact_totals(seed.subscriber_impact, T1).first()
    assert (one.congestion_events, one.total_affected_sessions, one.total_degraded_minutes) == (104, 3, 480.0)
    assert (one.voice_sessions, one.data_sessions, one.sms_sessions) == (2, 3, 0)
    assert tuple(serving.impact_totals(seed.subscriber_impact, "nobody").first()) == (0, 0, 0.0, 0, 0, 0)
    assert serving.impact_totals(seed.subscriber_impact).count() == 1


@pytest.fixture()
def alerts(spark):
    at = datetime(2025, 6, 27, 12)
    return spark.createDataFrame(
        [
            (1, T1, "CRITICAL", "HOTSPOT", 3, "m1", at, None, "ACTIVE"),
            (2, T2, "WARN", "HOTSPOT", 2, "m2", datetime(2025, 6, 28), None, "ACTIVE"),
            (3, T1, "PATTERN", "PEAK_HOUR", 2, "m3", at, None, "ACTIVE"),
            (4, T3, "WARN", "HOTSPOT", 2, "m4", at, NOW, "RESOLVED"),
        ],
        ALERT_SCHEMA,
    )


def test_active_alerts(seed, alerts):
    got = serving.active_alerts(alerts, seed.towers, NOW).collect()
    assert [r.alert_id for r in got] == [1, 3, 2]
    assert [r.days_active for r in got] == [1.5, 1.5, 1.0]
    pick = lambda **kw: [r.alert_id for r in serving.active_alerts(alerts, seed.towers, NOW, **kw).collect()]
    assert pick(alert_type="WARN") == [2]
    assert pick(alert_type="All", province="DKI Jakarta", island_group="Jawa") == [1, 3, 2]
    assert pick(province="Jawa Barat") == []


def test_alert_summary(seed, alerts):
    got = serving.alert_summary(alerts, seed.towers, NOW).first().asDict()
    assert got == {"total_active": 3, "critical_count": 1, "towers_affected": 2, "provinces_affected": 1, "oldest_alert_days": 1.5}
    none = serving.alert_summary(alerts.limit(0), seed.towers, NOW).first().asDict()
    assert none == {"total_active": 0, "critical_count": 0, "towers_affected": 0, "provinces_affected": 0, "oldest_alert_days": 0.0}


def test_overview(seed, alerts):
    assert tuple(serving.home_metrics(seed.towers, alerts, seed.network_health_snapshot).first()) == (3, 3, 90.0)
    assert [r.province_name for r in serving.provinces(seed.towers).collect()] == ["DKI Jakarta", "Jawa Barat"]
    assert rows(serving.filter_options(seed.towers)) == sorted(
        [("province", "All"), ("province", "DKI Jakarta"), ("province", "Jawa Barat"), ("island_group", "All"), ("island_group", "Jawa")],
        key=repr,
    )
    assert [r.tower_id for r in serving.tower_ids(seed.towers).collect()] == [T1, T2, T3]
    assert by_key(serving.partition_volume(seed.telemetry), "partition_date", "row_count")[date(2025, 6, 21)] == 72
