from datetime import datetime

import pytest

from cellgauge.plans import alerts as al
from cellgauge.schemas import ALERT_SCHEMA

from conftest import by_key, rows

NOW = datetime(2025, 6, 29, 12)
T1 = "twr000000001"


def hotspots(spark, *pairs):
    return spark.createDataFrame(list(pairs), "tower_id STRING, congestion_frequency_7d DOUBLE")


def existing(spark, *items):
    return spark.createDataFrame(
        [(i, t, "WARN", cat, 2, "m", datetime(2025, 6, 1), None, status) for i, (t, cat, status) in enumerate(items)],
        ALERT_SCHEMA,
    )


def test_hotspot_levels(spark):
    hot = hotspots(spark, ("a", 29.9), ("b", 30.0), ("c", 49.9), ("d", 50.0), ("e", 55.0))
    got = by_key(al.hotspot_alerts(hot, existing(spark), NOW), "tower_id", "alert_type", "severity")
    assert got == {"b": ("WARN", 2), "c": ("WARN", 2), "d": ("CRITICAL", 3), "e": ("CRITICAL", 3)}


def test_only_active_alerts_of_the_category_block(spark):
    hot = hotspots(spark, ("a", 60.0), ("b", 60.0), ("c", 60.0))
    old = existing(spark, ("a", "HOTSPOT", "ACTIVE"), ("b", "HOTSPOT", "RESOLVED"), ("c", "PEAK_HOUR", "ACTIVE"))
    assert rows(al.hotspot_alerts(hot, old, NOW), "tower_id") == [("b",), ("c",)]


def test_expiry(spark):
    old = existing(
        spark,
        ("low", "HOTSPOT", "ACTIVE"),
        ("edge", "HOTSPOT", "ACTIVE"),
        ("gone", "HOTSPOT", "ACTIVE"),
        ("done", "HOTSPOT", "RESOLVED"),
        ("peak", "PEAK_HOUR", "ACTIVE"),
        ("near", "NEIGHBOUR", "ACTIVE"),
    )
    got = by_key(al.expire_alerts(old, hotspots(spark, ("low", 9.9), ("edge", 10.0)), NOW), "tower_id", "status", "resolved_at")
    assert got == {
        "low": ("RESOLVED", NOW),
        "edge": ("ACTIVE", None),
        "gone": ("RESOLVED", NOW),
        "done": ("RESOLVED", None),
        "peak": ("ACTIVE", None),
        "near": ("ACTIVE", None),
    }


def test_first_and_second_run_on_the_seed(seed, spark):
    empty = existing(spark)
    hot = al.hotspot_alerts(seed.hotspot_summary, empty, NOW)
    assert rows(hot, "tower_id", "alert_type", "severity", "message") == [
        (T1, "CRITICAL", 3, f"Tower {T1} congestion frequency 54.2% over 7 days")
    ]
    peaks = al.peak_hour_alerts(seed.peak_hour_patterns, empty, NOW)
    assert rows(peaks, "message") == sorted(((f"Tower {T1} peak congestion at hour {h}",) for h in range(8, 21)), key=repr)
    one = al.peak_hour_alerts(seed.peak_hour_patterns, empty, NOW, one_per_tower=True)
    assert rows(one, "message") == [(f"Tower {T1} peak congestion at hour 8",)]

    marts = (seed.hotspot_summary, seed.peak_hour_patterns, seed.neighbour_impact)
    first = al.next_alerts(empty, *marts, NOW)
    assert first.columns == ALERT_SCHEMA.names
    stored = spark.createDataFrame(first.collect(), ALERT_SCHEMA)
    assert stored.count() == 14 and stored.select("alert_id").distinct().count() == 14
    second = al.next_alerts(stored, *marts, datetime(2025, 6, 30))
    assert rows(second) == rows(stored)


def test_neighbour_alerts_repeat_and_get_distinct_ids(spark):
    spill = spark.createDataFrame(
        [("s", "n", True), ("s", "n", True), ("r", "n", True)],
        "source_tower_id STRING, neighbour_tower_id STRING, is_spillover BOOLEAN",
    )
    new = al.with_alert_ids(al.neighbour_alerts(spill, existing(spark), NOW))
    assert new.count() == 3 and new.select("alert_id").distinct().count() == 3
    again = al.with_alert_ids(al.neighbour_alerts(spill.repartition(3), existing(spark), NOW))
    assert rows(again) == rows(new)
    one = al.neighbour_alerts(spill, existing(spark), NOW, one_per_tower=True)
    assert rows(one, "tower_id", "message") == [("n", "Spillover detected from congested tower r")]


@pytest.mark.parametrize("days, rate, expected", [(5, 70.0, 1), (4, 90.0, 0), (9, 69.9, 0)])
def test_peak_thresholds(spark, days, rate, expected):
    peaks = spark.createDataFrame(
        [("a", 8, rate, days)], "tower_id STRING, hour_of_day INT, congestion_occurrence_rate DOUBLE, days_congested BIGINT"
    )
    assert al.peak_hour_alerts(peaks, existing(spark), NOW).count() == expected
