"""Hotspot and peak-hour marts from partial sums that add up: a new day, or a late one, reads its own telemetry only.

One row for each tower, date and hour of day holds counts and sums. Months are sums of their days. The marts' windows of days are
sums over the last 31 dates, the figures over all time are sums over months; nothing is ever subtracted, so no rounding
builds up however often a day is replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.plans.marts import hotspot_hours, hotspots_of_hours, peaks_of_sums, tower_hours
from cellgauge.plans.scoring import has_profile
from cellgauge.sources.lake import PARTITION

# Sums over all time, and those that only windows of days need.
LIFETIME = ("hot_all", "prb_sum", "prb_count", "weight")
RECENT = ("seen", "profiled", "profiled_prb", "profiled_prb_count", "warm")
# Days of the windows.
WEEK, MONTH = 7, 30


def day_partials(scored: DataFrame, unique_hours: bool = False) -> DataFrame:
    """tower_id, partition_date (that of the hour), hour_of_day with the sums of LIFETIME and RECENT."""
    key = ["tower_id", F.to_date("event_hour").alias(PARTITION), F.hour("event_hour").alias("hour_of_day")]
    hours = tower_hours(scored, unique_hours)
    hot = hotspot_hours(hours.groupBy(*key), {"seen": F.count(F.lit(1))})
    warm = F.coalesce(F.col("prb_utilization") >= F.col("threshold_warn"), F.lit(False))
    known = scored.where(has_profile()).groupBy(*key).agg(
        F.count(F.lit(1)).alias("profiled"),
        F.sum("prb_utilization").alias("profiled_prb"),
        F.count("prb_utilization").alias("profiled_prb_count"),
        F.count_if(warm).alias("warm"),
    )
    names = ["tower_id", PARTITION, "hour_of_day"]
    return hot.join(known, names, "left").select(*names, *LIFETIME, *RECENT)


def month_partials(days: DataFrame) -> DataFrame:
    """The sums of LIFETIME by tower, month (its first date as partition_date) and hour of day."""
    month = F.trunc(PARTITION, "month").alias(PARTITION)
    return days.groupBy("tower_id", month, "hour_of_day").agg(*(F.sum(c).alias(c) for c in LIFETIME))


def hotspots_of_partials(months: DataFrame, days: DataFrame, as_of: Column) -> DataFrame:
    """The mart of :func:`marts.hotspot_summary`. ``days``: partials of the dates from ``as_of`` minus 30 on, or more."""
    age = F.datediff(as_of, F.col(PARTITION))
    recent = days.where(age <= MONTH)
    week = age <= WEEK
    windows = recent.groupBy("tower_id", "hour_of_day").agg(
        F.sum(F.when(week, F.col("seen")).otherwise(0)).alias("seen_7d"),
        F.sum(F.when(week, F.col("hot_all")).otherwise(0)).alias("hot_7d"),
        F.sum("seen").alias("seen_30d"),
        F.sum("hot_all").alias("hot_30d"),
    )
    life = months.groupBy("tower_id", "hour_of_day").agg(*(F.sum(c).alias(c) for c in LIFETIME))
    return hotspots_of_hours(life.join(windows, ["tower_id", "hour_of_day"], "left"))


def peaks_of_partials(days: DataFrame, as_of: Column) -> DataFrame:
    """The mart of :func:`marts.peak_hour_patterns`, from the partials of the dates from ``as_of`` minus 30 on."""
    recent = days.where((F.col(PARTITION) >= F.date_sub(as_of, MONTH)) & (F.col("profiled") > 0))
    sums = recent.groupBy("tower_id", "hour_of_day").agg(
        *(F.sum(c).alias(c) for c in ("profiled", "profiled_prb", "profiled_prb_count", "warm"))
    )
    return peaks_of_sums(sums)
