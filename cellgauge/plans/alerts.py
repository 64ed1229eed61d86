"""Alert rules as functions from one alerts snapshot to the next.

Each rule looks only at the snapshot before its own run, so one run may add several alerts for a tower
that had none: one per qualifying row of its mart. ``one_per_tower`` keeps the strongest instead. The
clock is the ``as_of`` argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions.columns import ntz, percent_text
from cellgauge.operators.dedupe import keep_first
from cellgauge.schemas import ALERT_SCHEMA

# Columns of a new alert. The categories, types and messages below are fixed values too.
NEW_COLUMNS = ("tower_id", "alert_type", "alert_category", "severity", "message", "triggered_at", "status")


def _without_active(candidates: DataFrame, alerts: DataFrame, category: str) -> DataFrame:
    active = alerts.where((F.col("alert_category") == category) & (F.col("status") == "ACTIVE"))
    return candidates.join(active.select("tower_id").distinct(), "tower_id", "left_anti")


def _alert(rows: DataFrame, category: str, kind: Column, severity: Column, message: Column, as_of: datetime):
    return rows.select(
        "tower_id",
        kind.alias("alert_type"),
        F.lit(category).alias("alert_category"),
        severity.cast("int").alias("severity"),
        message.alias("message"),
        ntz(as_of).alias("triggered_at"),
        F.lit("ACTIVE").alias("status"),
    )


def hotspot_alerts(
    hotspots: DataFrame, alerts: DataFrame, as_of: datetime, warn_at: float = 30.0, critical_at: float = 50.0
) -> DataFrame:
    often = F.col("congestion_frequency_7d")
    new = _without_active(hotspots.where(often >= warn_at), alerts, "HOTSPOT")
    grave = often >= critical_at
    text = F.concat(
        F.lit("Tower "), "tower_id", F.lit(" congestion frequency "), percent_text(often), F.lit(" over 7 days")
    )
    kind = F.when(grave, "CRITICAL").otherwise("WARN")
    return _alert(new, "HOTSPOT", kind, F.when(grave, 3).otherwise(2), text, as_of)


def peak_hour_alerts(
    peaks: DataFrame,
    alerts: DataFrame,
    as_of: datetime,
    min_rate: float = 70.0,
    min_days: int = 5,
    one_per_tower: bool = False,
) -> DataFrame:
    rows = peaks.where((F.col("congestion_occurrence_rate") >= min_rate) & (F.col("days_congested") >= min_days))
    new = _without_active(rows, alerts, "PEAK_HOUR")
    if one_per_tower:
        strongest = [F.desc("congestion_occurrence_rate"), F.desc("days_congested"), F.asc("hour_of_day")]
        new = keep_first(new, ["tower_id"], strongest)
    text = F.concat(F.lit("Tower "), "tower_id", F.lit(" peak congestion at hour "), F.col("hour_of_day").cast("string"))
    return _alert(new, "PEAK_HOUR", F.lit("PATTERN"), F.lit(2), text, as_of)


def neighbour_alerts(
    spillover: DataFrame, alerts: DataFrame, as_of: datetime, one_per_tower: bool = False
) -> DataFrame:
    rows = spillover.where("is_spillover").select(
        F.col("neighbour_tower_id").alias("tower_id"), F.col("source_tower_id").alias("_source")
    )
    new = _without_active(rows, alerts, "NEIGHBOUR")
    if one_per_tower:
        new = new.groupBy("tower_id").agg(F.min("_source").alias("_source"))
    text = F.concat(F.lit("Spillover detected from congested tower "), "_source")
    return _alert(new, "NEIGHBOUR", F.lit("SPILLOVER"), F.lit(2), text, as_of)


def with_alert_ids(new: DataFrame) -> DataFrame:
    """Ids from the content, so a retried task gives the same ids. Equal rows are counted and numbered
    without being gathered in one task."""
    numbered = (
        new.groupBy(*NEW_COLUMNS)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    )
    identity = F.concat_ws(
        "|",
        "tower_id",
        "alert_category",
        "message",
        F.date_format("triggered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.col("_copy").cast("string"),
    )
    digits = F.substring(F.sha2(identity, 256), 1, 15)
    return numbered.select(
        F.conv(digits, 16, 10).cast("bigint").alias("alert_id"),
        *NEW_COLUMNS[:-1],
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        "status",
    )


def expire_alerts(alerts: DataFrame, hotspots: DataFrame, as_of: datetime, keep_at: float = 10.0) -> DataFrame:
    """Resolve active hotspot alerts of towers below ``keep_at`` or gone from the mart. Alerts of other
    kinds never expire."""
    still_hot = (
        hotspots.where(F.col("congestion_frequency_7d") >= keep_at)
        .select("tower_id")
        .distinct()
        .withColumn("_hot", F.lit(True))
    )
    over = (F.col("status") == "ACTIVE") & (F.col("alert_category") == "HOTSPOT") & F.col("_hot").isNull()
    joined = alerts.join(still_hot, "tower_id", "left")
    return joined.withColumns(
        {
            "resolved_at": F.when(over, ntz(as_of)).otherwise(F.col("resolved_at")),
            "status": F.when(over, "RESOLVED").otherwise(F.col("status")),
        }
    ).select(*ALERT_SCHEMA.names)


def next_alerts(
    alerts: DataFrame,
    hotspots: DataFrame,
    peaks: DataFrame,
    spillover: DataFrame,
    as_of: datetime,
    warn_at: float = 30.0,
    critical_at: float = 50.0,
    min_rate: float = 70.0,
    min_days: int = 5,
    keep_at: float = 10.0,
    one_per_tower: bool = False,
) -> DataFrame:
    """One full cycle: the three rules add, then hotspot alerts expire. Running it again on its own
    result adds nothing."""
    new = (
        hotspot_alerts(hotspots, alerts, as_of, warn_at, critical_at)
        .unionByName(peak_hour_alerts(peaks, alerts, as_of, min_rate, min_days, one_per_tower))
        .unionByName(neighbour_alerts(spillover, alerts, as_of, one_per_tower))
    )
    return expire_alerts(
        alerts.select(*ALERT_SCHEMA.names).unionByName(with_alert_ids(new)), hotspots, as_of, keep_at
    )
