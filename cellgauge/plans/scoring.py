"""Telemetry joined to its tower's thresholds: the shared base of the marts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions.columns import capacity_weight, health_score, severity
from cellgauge.operators.joins import spread_join


def tower_profile(towers: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Tower with the thresholds of its cell type; towers of a type without thresholds drop out."""
    limits = thresholds.select("cell_type", "prb_warn_pct", "prb_critical_pct")
    return towers.select("tower_id", "cell_type").join(limits, "cell_type").drop("cell_type")


def score(
    telemetry: DataFrame, profile: DataFrame, profile_fits: bool | None = None, strict_nulls: bool = False
) -> DataFrame:
    """Readings without sensor fault, with thresholds, severity and health score. A reading whose
    tower has no profile stays, with NULL in those columns."""
    valid = telemetry.where(~F.col("is_sensor_fault"))
    joined = spread_join(valid, profile, ["tower_id"], "left", F.col("event_hour"), small_fits=profile_fits)
    return (
        joined.withColumnsRenamed({"prb_warn_pct": "threshold_warn", "prb_critical_pct": "threshold_critical"})
        .withColumn("severity", severity("prb_utilization", "threshold_warn", "threshold_critical"))
        .withColumn(
            "health_score",
            F.when(
                has_profile(),
                health_score("prb_utilization", "threshold_warn", "latency_ms", "dropped_call_rate", strict_nulls),
            ),
        )
    )


def has_profile() -> Column:
    return F.col("threshold_warn").isNotNull()


def capacity_shares(towers: DataFrame) -> DataFrame:
    """Each tower's share of the network's capacity weight."""
    weighted = towers.select("tower_id", "cell_type", capacity_weight("cell_type").alias("weight"))
    total = weighted.agg(F.sum("weight")).scalar()
    return weighted.withColumn("capacity_share", F.col("weight") / total)
